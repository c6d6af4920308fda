"""Near copies by the Jaccard similarity of word shingles: candidates of two kinds, exactly confirmed.

Texts with equal shingle sets are one node. Nodes are candidates if the SimHash fingerprints of their
shingles are linked by the vantage-point tree, or if they share a band of MinHash values: a pair at
the least similarity differs in some ten bits of its fingerprints, which no tree prunes, while it has
no band in common with a chance of 3 in a million. Candidates are tied to the least node of their
group, so they grow with the nodes, and tied pairs are confirmed by their whole shingle sets. Where
that leaves a component of candidates in several pieces, all links of similarity SIMILAR or more
within it are looked for. Only confirmed links count.

Defined results: as those of simhash; a text of fewer than WIDTH words is one shingle, and null and
wordless texts have one shingle in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keelstate.llm import common, simhash
from keelstate.llm.components import components
from keelstate.llm.simhash import SEED, majority

#: Words of a shingle, and the similarity from which texts link, as a fraction.
WIDTH, SIMILAR = 5, (4, 5)
#: Bands of MinHash values and values of a band; nodes of a block: a larger component of candidates is
#: compared in pairs of blocks.
BANDS, VALUES, BLOCK = 32, 5, 512

_RNG = np.random.default_rng(SEED)
_ODD, _PLUS = _RNG.integers(0, 1 << 31, (2, BANDS * VALUES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a UTF-8 text, in order."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(1, np.uint64)
    width = min(WIDTH, len(words))
    parts = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - width + 1))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of MinHash values."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * VALUES, np.iinfo(np.uint32).max)
    for at in range(0, len(high), 1 << 9):
        part = high[None, at : at + (1 << 9)] * _ODD[:, None]
        part ^= _PLUS[:, None]
        np.minimum(least, part.min(1), out=least)
    rows = least.astype("<u4").reshape(BANDS, VALUES)
    return np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64)


def _node(hashes: np.ndarray) -> int:
    return xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def _signed(numbers: np.ndarray | list) -> pa.Array:
    return pa.array(np.asarray(numbers, np.uint64).view(np.int64), pa.int64())


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text) for text in batch.column(2).to_pylist()]
        flat = _signed(np.concatenate([bands(s) for s in sets] or [np.zeros(0, np.uint64)]))
        ends = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
        columns = [
            _signed([_node(s) for s in sets]),
            pa.array([len(s) for s in sets], pa.int32()),
            _signed([majority(s) for s in sets]),
            pa.ListArray.from_arrays(ends, flat),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "fp", "n", "simhash", "bands"])


PRINTS = "doc_id long, text_key binary, fp long, n int, simhash long, bands array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text) for text in batch.column(0).to_pylist()]
        rows = pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([_signed([_node(s) for s in sets]), rows], ["of", "hashes"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough."""
    top, bottom = SIMILAR
    for batch in batches:
        keep = []
        for one, two in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(bottom * shared >= top * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Index pairs that span the components of all links of SIMILAR or more among distinct sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    waiting, marked = np.ones(len(sets), bool), np.zeros(len(kinds), bool)
    top, bottom = SIMILAR
    ends, others = [], []
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        reached = [first]
        while reached and waiting.any():
            one = reached.pop()
            own = flat[starts[one] : starts[one + 1]]
            marked[own] = True
            shared = np.bincount(owner[marked[flat]], minlength=len(sets))
            marked[own] = False
            near = np.flatnonzero(waiting & (bottom * shared >= top * (sizes + sizes[one] - shared)))
            waiting[near] = False
            reached += near.tolist()
            ends += [one] * len(near)
            others += near.tolist()
    return ends, others


def _block_links(rows: pa.Table) -> pa.Table:
    keys, first = np.unique(rows.column("fp").to_numpy(), return_index=True)
    hashes = rows.column("hashes")
    ends, others = forest([np.frombuffer(hashes[int(i)].as_py(), np.uint64) for i in first])
    return pa.table({"a": pa.array(keys[ends], pa.int64()), "b": pa.array(keys[others], pa.int64())})


def ties(nodes: DataFrame) -> DataFrame:
    """Candidate pairs of nodes (fp, n, simhash, bands) with their sizes (a, m, b, n): each node with the least one
    of each of its bands and of its fingerprint, and those least ones along the links of the tree."""
    least = [F.min("fp").alias("b"), F.min_by("n", "fp").alias("n")]
    bands = nodes.select(F.col("fp").alias("a"), F.col("n").alias("m"), F.lit(1).alias("kind"), F.explode("bands").alias("in"))
    dealt = bands.unionByName(nodes.select(F.col("fp").alias("a"), F.col("n").alias("m"), F.lit(0).alias("kind"), F.col("simhash").alias("in")))
    groups = dealt.withColumnsRenamed({"a": "fp", "m": "n"}).groupBy(F.col("kind").alias("k"), F.col("in").alias("g")).agg(*least, F.count("*").alias("many"))
    groups = groups.filter("many > 1").drop("many")
    shared = dealt.join(groups, (F.col("in") == F.col("g")) & (F.col("kind") == F.col("k"))).select("a", "m", "b", "n")
    firsts = common.settled(nodes.groupBy("simhash").agg(*least))
    linked = simhash.links(firsts.select(F.col("simhash").alias("fp"))).toDF("x", "y")
    linked = linked.join(firsts.toDF("xs", "a", "m"), F.col("x") == F.col("xs")).join(firsts.toDF("ys", "b", "n"), F.col("y") == F.col("ys"))
    return shared.unionByName(linked.select("a", "m", "b", "n")).filter("a <> b").distinct()


def _contracted(links: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b) between the components of held (node, root)."""
    for end in "ab":
        other = "b" if end == "a" else "a"
        links = links.join(held, F.col(end) == F.col("node"), "left").select(F.coalesce("root", end).alias(end), other)
    return links.filter("a <> b").select("a", "b").distinct()


def _composed(held: DataFrame, above: DataFrame) -> DataFrame:
    """held (node, root) after its components have been joined by above (node, root)."""
    up = above.toDF("of", "to")
    return held.join(up, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(above)


def joined(docs: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root): the components of confirmed links of nodes (fp, least, n, simhash, bands)."""
    spark, path = docs.sparkSession, common.scratch(docs.sparkSession, "near-links")
    common.store(ties(nodes), f"{path}/ties")
    tied = spark.read.schema("a long, m int, b long, n int").parquet(f"{path}/ties")
    among = tied.select("a").union(tied.select("b")).distinct()
    # One document's text gives a node's set; documents without an id are looked through.
    ids = nodes.join(among, F.col("fp") == F.col("a")).select(F.col("least").alias("id")).distinct()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    wanted = read.join(ids, F.col("doc_id") == F.col("id"), "left_semi").unionByName(read.filter("doc_id is null"))
    common.store(wanted.select("text").mapInArrow(_sets, SETS).groupBy("of").agg(F.first("hashes").alias("hashes")), f"{path}/sets")
    sets = spark.read.schema(SETS).parquet(f"{path}/sets")
    top, bottom = SIMILAR
    likely = tied.filter(bottom * F.least("m", "n") >= top * F.greatest("m", "n")).select("a", "b")  # sets of other sizes can't be
    pairs = (
        likely.join(sets.withColumnRenamed("hashes", "x"), F.col("a") == F.col("of")).drop("of")
        .join(sets.withColumnRenamed("hashes", "y"), F.col("b") == F.col("of")).select("a", "b", "x", "y")
    )
    held = components(pairs.mapInArrow(_confirmed, "a long, b long"))
    # Where ties lead from one component to another, all pairs of the nodes of both are looked through.
    open_ = components(_contracted(tied.select("a", "b"), held))
    if open_.isEmpty():
        return held
    parts = open_.union(open_.select("root", "root").distinct()).toDF("piece", "whole")
    pieces = among.join(held, F.col("a") == F.col("node"), "left").select("a", F.coalesce("root", "a").alias("of_piece"))
    rest = common.settled(pieces.join(parts, F.col("of_piece") == F.col("piece")).select("a", "whole"))
    sizes = rest.groupBy(F.col("whole").alias("of_whole")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    found = rest.join(sizes, F.col("whole") == F.col("of_whole")).join(sets, F.col("a") == F.col("of"))
    own = found.withColumn("own", F.pmod(F.xxhash64("a", F.lit(1)), F.col("blocks")).cast("int"))
    crossed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = (
        crossed.select("whole", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("a").alias("fp"), "hashes")
        .groupBy("whole", "i", "j")
        .applyInArrow(_block_links, "a long, b long")
    )
    return _composed(held, components(_contracted(others, held)))


SETS = "of long, hashes binary"


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, root, component_id) of every row: its component, and the smallest doc_id in that."""
    spark = common.prepare(docs.sparkSession)
    path = common.scratch(spark, "near")
    text = F.col("text")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(text).alias("text_key"), text.cast("binary").alias("text"))
    common.store(read.mapInArrow(_prints, PRINTS), path)
    prints = spark.read.schema(PRINTS).parquet(path)
    same = [F.first(c).alias(c) for c in ("n", "simhash", "bands")]
    nodes = common.settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), *same))
    return simhash.grouped(prints.select("doc_id", "text_key", "fp"), joined(docs, nodes))


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that confirmed links reach."""
    return groups(docs).select("doc_id", "component_id")
