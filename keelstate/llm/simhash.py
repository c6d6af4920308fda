"""SimHash near-duplicates, linked exactly by vantage-point trees.

A vantage-point tree partitions the distinct fingerprints by their Hamming distance from the vantage
of each node. A fingerprint goes to the near child up to the node's radius and to the far child
beyond it; by the triangle inequality only fingerprints within the link distance below the radius
can link across, so those are sent to the far child too. All linked pairs thus meet in some leaf.
The top of the tree, fitted on a bounded sample, deals the fingerprints to tasks; each task goes on
with a tree of its own leaf's points, down to parts in which fingerprints are ringed by distance from
one more vantage and only rings at most the link distance apart are compared. Where a vantage parts
nothing, because near copies crowd around it, links are found by common one-bit neighbours instead:
fingerprints are within two bits if and only if they share one. That is linear in their number, and
a leaf that is too large for a task is settled so by all tasks together. A leaf gives a spanning
forest of its links, never its pairs; components of the forests are then found by star steps.

Defined results: a null or wordless text has fingerprint zero; a document with a null id takes part
and has a null component only where all ids that it reaches are null; repeated rows are answered
one by one; an empty table gives no rows; only doc_id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keelstate.llm import common
from keelstate.llm.components import components

#: Words of a shingle, bits at which fingerprints link at most, and the hash's seed.
SHINGLE, LINK_BITS, SEED = 3, 2, 42
#: Fingerprints that the top of the tree is fitted on, fingerprints aimed at in a leaf of it, and those
#: that one task takes at most: the links of larger leaves are found by all tasks together.
TREE_SAMPLE, LEAF, LEAF_MOST = 1 << 16, 1 << 13, 1 << 20
#: Points that are compared ring by ring at most; share of points, copies included, up to which a vantage
#: parts well enough; and one-bit neighbours that are sorted at once.
RINGS, PARTED, SORTED = 1 << 10, 1.5, 1 << 22
_FLIPS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if width > 1 else iter(words)
    n = len(words) - width + 1
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        rows = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text) for text in batch.column(2).to_pylist()]
        signed = np.array(found, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.int64())], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, the text's digest (if keyed, else null) and the fingerprint as a long."""
    common.prepare(docs.sparkSession)
    key = common.text_key(F.col("text")) if keyed else F.lit(None).cast("binary")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(_fingerprints, PRINTS)


PRINTS = "doc_id long, text_key binary, fp long"


class Tree:
    """Top of a vantage-point tree: node i has children 2i+1 (near) and 2i+2 (far)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.vantage = np.zeros((1 << depth) - 1, np.uint64)
        self.radius = np.full((1 << depth) - 1, 64, np.int64)
        parts = {0: sample}
        for node in range(len(self.vantage)):
            part = parts.pop(node)
            if len(part):
                self.vantage[node] = part[0]
                away = np.bitwise_count(part ^ part[0])
                self.radius[node] = np.median(away)
                far = away > self.radius[node]
            else:
                far = np.zeros(0, bool)
            if 2 * node + 2 < len(self.vantage):
                parts[2 * node + 1], parts[2 * node + 2] = part[~far], part[far]

    def leaves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each point and of its copies past near boundaries."""
        rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            away = np.bitwise_count(points[rows] ^ self.vantage[nodes]).astype(np.int64)
            radius = self.radius[nodes]
            near = away <= radius
            copied = near & (away + LINK_BITS > radius)
            far_nodes = 2 * nodes + 2
            rows, nodes = (
                np.concatenate([rows, rows[copied]]),
                np.concatenate([np.where(near, 2 * nodes + 1, far_nodes), far_nodes[copied]]),
            )
        return rows, nodes


def _near(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within LINK_BITS; of one set with itself each pair once."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= LINK_BITS)
        i = i + at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        left.append(i)
        right.append(j)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component under links a-b."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def rings(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within LINK_BITS of distinct points, found ring by ring from one vantage."""
    away = np.bitwise_count(points ^ points[0])
    order = np.argsort(away, kind="stable")
    points, away = points[order], away[order]
    starts = np.searchsorted(away, np.arange(66 + LINK_BITS))
    ends, others = [], []
    for ring in range(65):
        first, last = starts[ring], starts[ring + 1]
        if first == last:
            continue
        i, j = _near(points[first:last], points[first:last], True)
        ends.append(i + first)
        others.append(j + first)
        beyond = starts[min(ring + 1 + LINK_BITS, 65)]
        if beyond > last:
            i, j = _near(points[first:last], points[last:beyond], False)
            ends.append(i + first)
            others.append(j + last)
    return order[np.concatenate(ends)], order[np.concatenate(others)]


def crowded(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the components of distinct points, by the one-bit neighbours that they share."""
    dealt = -(-len(points) * len(_FLIPS) // SORTED)
    ends, others = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, SORTED // len(_FLIPS))
    for part in range(dealt):
        keys, owners = [], []
        for at in range(0, len(points), step):
            own = points[at : at + step, None] ^ _FLIPS
            mine = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(dealt) == np.uint64(part)
            keys.append(own[mine])
            owners.append(np.nonzero(mine)[0] + at)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        same = key[1:] == key[:-1]
        root = roots(len(points), np.concatenate([ends, owner[:-1][same]]), np.concatenate([others, owner[1:][same]]))
        ends = np.flatnonzero(root != np.arange(len(points)))
        others = root[ends]
    return ends, others


def forest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct points, by a vantage-point tree of these points."""
    rng = np.random.default_rng(SEED)
    ends, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting = [np.arange(len(points))]
    while waiting:
        part = waiting.pop()
        if not len(part):
            continue
        own = points[part]
        if len(part) <= RINGS:
            i, j = rings(own)
        else:
            away = np.bitwise_count(own ^ own[rng.integers(len(own))]).astype(np.int64)
            radius = int(np.median(away))
            near, far = part[away <= radius], part[away + LINK_BITS > radius]
            if len(far) < len(part) and len(near) + len(far) <= PARTED * len(part):
                waiting += [near, far]
                continue
            i, j = crowded(own)
        ends.append(part[i])
        others.append(part[j])
    root = roots(len(points), np.concatenate(ends), np.concatenate(others))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return points[linked], points[root[linked]]


def _leaf_links(rows: pa.Table) -> pa.Table:
    """Links of one leaf."""
    a, b = forest(np.unique(rows.column("fp").to_numpy().view(np.uint64)))
    return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})


def links(points: DataFrame, leaf: int = LEAF, most: int = LEAF_MOST, sample: int = TREE_SAMPLE) -> DataFrame:
    """(a, b): links that span the components of the distinct fingerprints in column fp."""
    points = points.select("fp")
    with common.cleaned(points.sparkSession):
        total = points.count()
        drawn = points.orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow()
    seen = np.unique(drawn.column("fp").to_numpy().view(np.uint64))
    np.random.default_rng(SEED).shuffle(seen)
    depth = min(max(0, int(np.ceil(np.log2(max(1, total) / leaf)))), int(np.log2(max(1, len(seen)))))
    tree = Tree(seen, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0))
            rows, nodes = tree.leaves(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(fps[rows], pa.int64())], ["leaf", "fp"])

    dealt = points.mapInArrow(deal, "leaf long, fp long")
    # There are at most as many leaves as the sample has points.
    with common.cleaned(points.sparkSession):
        large = [row.leaf for row in dealt.groupBy("leaf").count().filter(F.col("count") > most).collect()]
    small = dealt.filter(~F.col("leaf").isin(large)) if large else dealt
    found = small.groupBy("leaf").applyInArrow(_leaf_links, "a long, b long")
    return found.unionByName(_shared(dealt.filter(F.col("leaf").isin(large)).select("fp").distinct())) if large else found


def _shared(points: DataFrame) -> DataFrame:
    """crowded() by all tasks: a neighbour is shared by 65 distinct fingerprints at most."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = points.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("key"))
    groups = around.groupBy("key").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b").distinct()


def grouped(prints: DataFrame, joined: DataFrame) -> DataFrame:
    """prints (doc_id, fp, ...) with root and component_id; joined (node, root) are the components of fp."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = nodes.join(joined, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("print"), "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = groups.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    answer = groups.join(smallest, F.col("root") == F.col("of")).select("print", "root", "component_id")
    return prints.join(answer, F.col("fp") == F.col("print")).drop("print")


def _grouped(docs: DataFrame, keyed: bool) -> DataFrame:
    spark = common.prepare(docs.sparkSession)
    path = common.scratch(spark, "fingerprints")
    common.store(fingerprints(docs, keyed), path)
    prints = spark.read.schema(PRINTS).parquet(path)
    return grouped(prints, components(links(common.settled(prints.select("fp").distinct()))))


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that can be reached."""
    return _grouped(docs, False).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of each component, with all its columns: of those with the smallest id the first by text digest.

    found tells the component (root) of each id and text digest (doc_id, text_key), as _grouped() does,
    which is asked where none is given. Rows are told apart by id and text, so an id that repeats with
    other texts, or is null, costs none of them. Of rows equal in both, the first by its other columns stays.
    """
    spark = common.prepare(docs.sparkSession)
    path = common.scratch(spark, "groups")
    found = _grouped(docs, True) if found is None else found
    common.store(found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")), path)
    groups = spark.read.schema("root long, doc_id long, text_key binary, n long").parquet(path)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = groups.groupBy(F.col("root").alias("of")).agg(F.min(first).alias("best"), F.count("*").alias("many")).filter("many > 1")
    id_, key, place = (common.fresh(docs, name) for name in ("__gone", "__key", "__first"))
    named = [F.col("doc_id").alias(id_), F.col("text_key").alias(key + "_")]
    gone = groups.join(best, F.col("root") == F.col("of")).filter(~first.eqNullSafe(F.struct("best.*"))).select(*named)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key + "_"))
    kept = docs.withColumn(key, common.text_key(F.col("text"))).join(gone, same, "left_anti")
    repeated = groups.filter("n > 1").select(*named)
    if repeated.isEmpty():
        return kept.drop(key)
    rest = F.to_json(F.struct(F.lit(0), *(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))))
    rank = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(rest))
    several = kept.join(repeated, same, "left_semi").withColumn(place, rank).filter(F.col(place) == 1)
    return kept.join(repeated, same, "left_anti").select(*docs.columns).unionByName(several.select(*docs.columns))
