"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are token counts of whole texts under a byte-level BPE vocabulary. A text longer than the
largest permitted length is cut into pieces of that length and a rest. Pieces are dealt evenly to
shards of bounded size, and each shard is packed by decreasing best fit: a piece goes to the open
bin that it fills best; where none has room, every permitted length is weighed by its cost over
what it would hold with the pieces still to come, and the cheapest is opened. At last each bin is
downsized to the smallest permitted length that holds its contents.

Defined results: a null or empty text has no tokens: one row without a bin; repeated rows are
packed one by one; pieces of equal length go by doc_id, then by a hash of the text and by place; an empty
table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common

#: Permitted sequence lengths in tokens, and what a bin costs besides its length.
SIZES, OPENING = (512, 1024, 2048, 4096, 8192), 32
#: Pieces of a shard on average, and pieces that are tried when a new bin's contents are foreseen.
SHARD, FORESEEN = 8192, 8
#: The vocabulary of the token counts: a file of base64 tokens and ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

SCHEMA = (
    "doc_id long, first_token long, n_tokens long, bin string, capacity int, bin_offset int, bin_tokens int"
)

#: Fixed value: the pattern that splits a text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Counter:
    """Token counts of whole texts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text_hash and n_tokens of every whole text."""
    common.prepare(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # one file's entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            counts = [counter.count(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "text_hash", "n_tokens"])

    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(doc_id, F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, LENGTHS)


LENGTHS = "doc_id long, text_hash long, n_tokens long"


class Packer:
    """Decreasing best fit of whole lengths into bins of the permitted sizes."""

    def __init__(self, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] | None = None):
        self.sizes = sorted(set(sizes))
        self.cost = cost or (lambda size: size + OPENING)

    def _foreseen(self, room: int, left: list[int], lengths: int) -> int:
        """Tokens that the pieces still to come would fill of some room, largest first."""
        filled, taken = 0, {}
        for _ in range(FORESEEN):
            fitting = lengths & ((1 << (room - filled + 1)) - 1)
            if not fitting:
                break
            length = fitting.bit_length() - 1
            n = min(left[length] - taken.get(length, 0), (room - filled) // length)
            filled += n * length
            taken[length] = taken.get(length, 0) + n
            if taken[length] == left[length]:
                lengths &= ~(1 << length)
        return filled

    def pack(self, lengths: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
        """For falling lengths: the bin of each, each bin's final size and its contents."""
        most = self.sizes[-1]
        left = [0] * (most + 1)
        for length in lengths:
            left[length] += 1
        ahead = 0
        for length, n in enumerate(left):
            if n:
                ahead |= 1 << length
        bins: list[int] = []
        held: list[int] = []
        room: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by free tokens
        open_rooms = 0
        for length in lengths:
            left[length] -= 1
            if not left[length]:
                ahead &= ~(1 << length)
            if fitting := open_rooms >> length:
                free = length + (fitting & -fitting).bit_length() - 1
                chosen = room[free].pop()
                if not room[free]:
                    open_rooms &= ~(1 << free)
            else:
                chosen = len(held)
                held.append(0)
                free = min(
                    (size for size in self.sizes if size >= length),
                    key=lambda size: (self.cost(size) / (length + self._foreseen(size - length, left, ahead)), size),
                )
            held[chosen] += length
            bins.append(chosen)
            free -= length
            if free:
                room[free].append(chosen)
                open_rooms |= 1 << free
        return bins, [min(size for size in self.sizes if size >= n) for n in held], held


def _pack_shard(sizes: Sequence[int], cost: Callable[[int], float] | None):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "descending" if c == "n_tokens" else "ascending") for c in ("n_tokens", "doc_id", "text_hash", "first_token")])
        lengths = rows.column("n_tokens").to_pylist()
        bins, capacity, held = Packer(sizes, cost).pack(lengths)
        offsets, filled = [], [0] * len(held)
        for chosen, length in zip(bins, lengths):
            offsets.append(filled[chosen])
            filled[chosen] += length
        shard = rows.column("shard")[0].as_py()
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "first_token": rows.column("first_token"),
                "n_tokens": rows.column("n_tokens"),
                "bin": pa.array([f"{shard}-{b}" for b in bins], pa.string()),
                "capacity": pa.array([capacity[b] for b in bins], pa.int32()),
                "bin_offset": pa.array(offsets, pa.int32()),
                "bin_tokens": pa.array([held[b] for b in bins], pa.int32()),
            }
        )

    return run


def pack(
    docs: DataFrame,
    sizes: Sequence[int] = SIZES,
    path: str = VOCABULARY,
    shard: int = SHARD,
    cost: Callable[[int], float] | None = None,
) -> DataFrame:
    """One row per piece: its document, its place there, its bin, the bin's size and its place in it.

    The token counts, three numbers a document, are written to the shared folder, so texts are read
    once. Pieces are dealt to shards by a hash of id, text and, of rows that repeat in both, a number,
    so neither repeated nor null ids gather in one shard, and the same rows are packed the same way
    whatever files they come from.
    """
    spark = common.prepare(docs.sparkSession)
    counted = common.scratch(spark, "lengths")
    token_counts(docs, path).write.parquet(counted)
    lengths = spark.read.schema(LENGTHS).parquet(counted)
    most = max(sizes)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(most).cast("long")))
    shards = max(1, -(-lengths.agg(F.sum(F.ceil(F.col("n_tokens") / most))).first()[0] // shard)) if lengths.head(1) else 1
    alike = lengths.filter("n_tokens > 0").groupBy("doc_id", "text_hash", "n_tokens").agg(F.count("*").alias("n"))
    numbered = alike.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    pieces = (
        numbered.withColumn("first_token", begin)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "place", "first_token"), F.lit(int(shards))))
        .select(
            "shard", "doc_id", "text_hash", "first_token", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(most).cast("long")).alias("n_tokens")
        )
    )
    packed = pieces.groupBy("shard").applyInArrow(_pack_shard(tuple(sizes), cost), SCHEMA)
    nothing = lengths.filter("n_tokens = 0").selectExpr(
        "doc_id", "0L as first_token", "n_tokens", "cast(null as string) as bin", "cast(null as int) as capacity",
        "cast(null as int) as bin_offset", "cast(null as int) as bin_tokens",
    )
    return packed.unionByName(nothing)
