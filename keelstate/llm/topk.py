"""Exact top-k inner products by a bit-sliced index.

Each component is quantised to floor(SCALE * x). A block of rows stores every component, counted
from the block's smallest value, as bitmaps: slice b holds bit b of all rows. The index is written
once, a block a row, and read by each block of queries. A query adds, for each set bit of each of
its weights, the slices of that component (their complements where the weight is negative) with
carry-save bitmap arithmetic; the sums are again bit slices. The best rows are read off from the
most significant slice downward; rows that tie at the boundary are taken by the smaller id, and the
chosen rows' scores are taken from their exact integer product.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows with
a null id, take no part; a query sees vectors of its own length only; a repeated candidate row is
listed each time; a repeated query id is answered once, for its smallest vector; an empty table
gives no rows. Rows and queries with a scaled component past WIDE in absolute value, whose sums
might not fit a long on the way, are multiplied in whole numbers without a bound; a component counts
as at most the largest long, and so does a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelstate.llm import common

SCALE, K, QUERY_STEP = 1024, 10, 100
#: Bytes of an index block's vectors, blocks of a file, queries that are sent out at once, and the largest
#: scaled component that is sliced.
BLOCK_BYTES, FILE_BLOCKS, QUERY_BLOCK, WIDE = 1 << 24, 4, 4096, 1 << 24

SCHEMA = "query_id long, vec_id long, score long"
INDEX = "dim int, wide boolean, bits int, ids binary, vectors binary, planes binary"
_LONG = (1 << 63) - 1


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit slices (column, bit, word) of rows of whole numbers >= 0."""
    words = -(-len(values) // 64)
    out = np.zeros((values.shape[1], bits, words), np.uint64)
    padded = np.zeros((words * 64, values.shape[1]), np.uint8)
    for bit in range(bits):
        padded[: len(values)] = (values >> bit) & 1
        out[:, bit] = np.packbits(padded, axis=0, bitorder="little").T.copy().view(np.uint64)
    return out


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """The index of some rows, which stand by rising id; without slices if their components are too wide."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, wide: bool = False, planes: np.ndarray | None = None):
        if planes is None:
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            if not wide:
                above = vectors - vectors.min(0)
                planes = slices(above, int(above.max(initial=0)).bit_length())
        self.ids, self.vectors, self.wide, self.planes = ids, vectors, wide, planes
        self.words = -(-len(ids) // 64)
        all_rows = np.zeros(self.words * 64, np.uint8)
        all_rows[: len(ids)] = 1
        self.rows = np.packbits(all_rows, bitorder="little").view(np.uint64)

    def packed(self) -> dict:
        vectors = self.vectors if self.wide else self.vectors.astype("<i4")
        planes = b"" if self.wide else self.planes.tobytes()
        bits = 0 if self.wide else self.planes.shape[1]
        return {"dim": vectors.shape[1], "wide": self.wide, "bits": bits, "ids": self.ids.tobytes(), "vectors": vectors.tobytes(), "planes": planes}

    @classmethod
    def unpacked(cls, row: dict) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.int64 if row["wide"] else "<i4").reshape(-1, row["dim"])
        planes = np.frombuffer(row["planes"], np.uint64).reshape(row["dim"], row["bits"], -(-len(ids) // 64))
        return cls(ids, vectors if row["wide"] else vectors.astype(np.int64), row["wide"], planes)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the score of every row, less a constant of the query and block."""
        columns: dict[int, list[np.ndarray]] = {}
        for j, weight in enumerate(query.tolist()):
            planes = self.planes[j] if weight > 0 else ~self.planes[j]  # 2^bits - 1 less the value
            weight, shift = abs(weight), 0
            while weight:
                if weight & 1:
                    for bit, plane in enumerate(planes):
                        columns.setdefault(shift + bit, []).append(plane)
                weight >>= 1
                shift += 1
        out, at = [], 0
        while columns:
            pile = columns.pop(at, [])
            above = columns.setdefault(at + 1, []) if len(pile) > 1 else None
            while len(pile) > 2:
                a, b, c = pile.pop(), pile.pop(), pile.pop()
                half = a ^ b
                above.append((a & b) | (half & c))
                pile.append(half ^ c)
            if len(pile) == 2:
                a, b = pile
                above.append(a & b)
                pile = [a ^ b]
            out.append(pile[0] if pile else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id isn't the query's."""
        first, last = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        if self.wide or np.abs(query.astype(object)).max() > WIDE:
            return self._plain_top(first, last, query, k)
        tied = self.rows.copy()
        for row in range(first, last):
            tied[row >> 6] &= ~np.uint64(1 << (row & 63))
        sure = np.zeros(self.words, np.uint64)
        for plane in reversed(self.sums(query)):
            ahead = tied & plane
            n = int(np.bitwise_count(sure | ahead).sum())
            if n > k:
                tied = ahead
            else:
                sure |= ahead
                tied = tied & ~plane
                if n == k:
                    tied[:] = 0
                    break
        rows = members(sure)
        rows = np.concatenate([rows, members(tied)[: k - len(rows)]])
        return self.ids[rows], self.vectors[rows] @ query

    def _plain_top(self, first: int, last: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """top() in whole numbers of any size, a row at a time."""
        weights = query.tolist()
        found = []
        for i, row in enumerate(self.vectors):
            if not first <= i < last:
                score = sum(x * w for x, w in zip(row.tolist(), weights))
                found.append((-min(_LONG, max(-_LONG, score)), int(self.ids[i])))
        found = sorted(found)[:k]
        return np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)


def usable(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and the quantised vector of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return embeddings.filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")
    )


def _build(block_bytes: int):
    """Index blocks of a task's rows, one at a time, by their vectors' length and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, bool], list] = {}
        held: dict[tuple[int, bool], int] = {}

        def block(of: tuple[int, bool]) -> pa.RecordBatch:
            held[of] = 0
            ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(of)))
            return pa.RecordBatch.from_pylist([Block(ids, vectors, of[1]).packed()], _PACKED)

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                part = flat[(starts[rows][:, None] + np.arange(dim)[None]).ravel()].reshape(len(rows), dim)
                far = ((part > WIDE) | (part < -WIDE)).any(1)
                for wide in (False, True):
                    chosen = far == wide
                    if chosen.any():
                        waiting.setdefault((dim, wide), []).append((ids[rows[chosen]], part[chosen]))
                        held[dim, wide] = held.get((dim, wide), 0) + int(chosen.sum())
                        if held[dim, wide] * dim * 4 >= block_bytes:
                            yield block((dim, wide))
        for of in list(waiting):
            yield block(of)

    return run


_PACKED = pa.schema(
    [("dim", pa.int32()), ("wide", pa.bool_()), ("bits", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("planes", pa.binary())]
)


def _probe(queries: dict[int, list[tuple[int, np.ndarray]]], k: int):
    """Every query of the block asks every index block of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.unpacked(batch.slice(i, 1).to_pylist()[0])
                found = [(own, *block.top(own, query, k)) for own, query in queries.get(block.vectors.shape[1], ())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([x[0] for x in found], [len(x[1]) for x in found]) if found else [], pa.int64()),
                        pa.array(np.concatenate([x[1] for x in found]) if found else [], pa.int64()),
                        pa.array(np.concatenate([x[2] for x in found]) if found else [], pa.int64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return run


def search(embeddings: DataFrame, query_rows, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best rows of each query: query_id, rank from 1, vec_id, score; ties go to the smaller id.

    query_rows is the condition that marks the query rows. They stream to the driver and go out in
    blocks of at most query_block. The index is written to the shared folder once, and answers of
    more than one block of queries are too. The shuffle carries at most k rows a query and map task.
    """
    spark = common.prepare(embeddings.sparkSession)
    index_path = common.scratch(spark, "index")
    usable(embeddings, scale).mapInArrow(_build(block_bytes), INDEX).write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(index_path)
    index = spark.read.schema(INDEX).parquet(index_path)
    asked = usable(embeddings.filter(query_rows), scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks: list[DataFrame] = []
    path, block = None, {}

    def ask(block):
        return index.mapInArrow(_probe(block, k), SCHEMA)

    n = 0
    for row in asked.toLocalIterator():
        if n == query_block:
            path = path or common.scratch(spark, "answers")
            ask(block).write.mode("append").parquet(path)
            block, n = {}, 0
        block.setdefault(len(row.v), []).append((row.vec_id, np.array(row.v, np.int64)))
        n += 1
    if path:
        ask(block).write.mode("append").parquet(path)
        found = spark.read.schema(SCHEMA).parquet(path)
    else:
        found = ask(block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
