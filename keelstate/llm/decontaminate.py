"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark item. Words are the symbols: a block is
two neighbouring words, a shift table says how far the search may move on after a block, and the
patterns that end in a block stand in a bucket which is compared directly.

Defined results: a null or wordless text has no words and no hits; an item with a null id or
without words is left out; items that share an id count once; repeated documents are answered one
by one; an empty benchmark hits nothing; only doc_id and text of a document are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common

#: Consecutive words of a window, and items from which a document counts as contaminated.
WINDOW, MIN_ITEMS = 8, 2
#: Items from which remove() takes a document out: a window of a single one is a leak already.
LEAK_ITEMS = 1
#: Windows that are searched, and broadcast, at once. More windows are searched in several passes.
BLOCK_WINDOWS = 200_000

#: A-Z go to a-z; a-z, 0-9 and all bytes of non-ASCII letters stay; the rest separates.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


def windows(item: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    if item:
        for start in range(max(1, len(item) - width + 1)):
            yield tuple(item[start : start + width])


class Matcher:
    """Wu-Manber tables for patterns of one length."""

    TABLE_BITS = 18

    def __init__(self, length: int, patterns: dict[tuple[int, ...], frozenset]):
        self.length, self.block = length, min(2, length)
        self.mask = (1 << self.TABLE_BITS) - 1
        farthest = min(255, length - self.block + 1)
        self.shift = bytearray([farthest]) * (self.mask + 1)
        #: By the suffix block, then by the first word: patterns to compare.
        self.buckets: dict[int, dict[int, list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block - 1, length):
                at = self._slot(pattern[end - 1] if self.block == 2 else 0, pattern[end])
                self.shift[at] = min(self.shift[at], length - 1 - end, 255)
            self.buckets.setdefault(at, {}).setdefault(pattern[0], []).append((list(pattern), items))

    def _slot(self, before: int, last: int) -> int:
        return (before * 40_503 + last) & self.mask

    def search(self, ids: list[int]) -> Iterator[tuple[int, int, frozenset]]:
        """Each occurrence as (first word, end, items), by rising end."""
        shift, mask, length, buckets = self.shift, self.mask, self.length, self.buckets
        pairs, at, end = self.block == 2, length - 1, len(ids)
        while at < end:
            slot = ((ids[at - 1] if pairs else 0) * 40_503 + ids[at]) & mask
            if step := shift[slot]:
                at += step
                continue
            first = at - length + 1
            for pattern, items in buckets[slot].get(ids[first], ()):
                if ids[first : at + 1] == pattern:
                    yield first, at + 1, items
            at += 1


class Search:
    """All patterns of one block of benchmark windows."""

    def __init__(self, found: Iterable[tuple[object, tuple[bytes, ...]]]):
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = {}
        for item, window in found:
            ids = tuple(vocabulary.setdefault(word, len(vocabulary) + 1) for word in window)
            by_length.setdefault(len(ids), {}).setdefault(ids, set()).add(item)
        self.vocabulary = vocabulary
        self.matchers = [
            Matcher(length, {k: frozenset(v) for k, v in patterns.items()}) for length, patterns in by_length.items()
        ]

    def document(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs of hit words, and the items that occur."""
        get = self.vocabulary.get
        ids = [get(word, 0) for word in found]
        spans: list[tuple[int, int]] = []
        items: set = set()
        for matcher in self.matchers:
            for first, end, of in matcher.search(ids):
                spans.append((first, end))
                items |= of
        return merge(spans), items


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def digest(items: Iterable) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def searches(benchmark: DataFrame, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> Iterator[Search]:
    """One search per block of the benchmark; rows stream to the driver, a block at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).filter("item_id is not null")
    block: list = []
    for row in rows.toLocalIterator():
        for window in windows(words(row.text and bytes(row.text)), width):
            block.append((row.item_id, window))
            if len(block) >= block_windows:
                yield Search(block)
                block = []
    if block:
        yield Search(block)


def _hits(search: Search, every: bool):
    """Rows' keys, words, runs and items for one block of the benchmark; only rows with hits, unless every."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                runs, of = search.document(found := words(text))
                if runs or every:
                    out.append((doc_id, key, len(found), [r[0] for r in runs], [r[1] for r in runs], sorted(map(str, of))))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _HIT_KINDS)], _HIT_NAMES)

    return run


_HITS = "doc_id long, text_key binary, n_words long, firsts array<long>, ends array<long>, items array<string>"
_HIT_NAMES = [part.split()[0] for part in _HITS.split(", ")]
_HIT_KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    min_items: int = MIN_ITEMS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, their digest and the verdict.

    A benchmark of one block is searched in a single pass without a shuffle. A larger one is
    searched block by block, each broadcast being bounded by block_windows; what is shuffled then
    are keys, counts and hits, never texts.
    """
    spark = common.prepare(docs.sparkSession)
    pieces = searches(benchmark, width, block_windows)
    first, second = next(pieces, Search([])), next(pieces, None)
    if second is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    runs, items = first.document(found := words(body))
                    hit = sum(end - start for start, end in runs)
                    out.append((doc_id, len(found), hit, len(items), digest(items), len(items) >= min_items))
                yield _result(out)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)

    rows, hits = _blocks(docs, itertools.chain([first, second], pieces))
    joined = rows.join(hits, F.col("text_key") == F.col("hit_key"), "left").select("doc_id", "n_words", "firsts", "ends", "items")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, firsts, ends, items in zip(*(batch.column(i).to_pylist() for i in range(5))):
                hit = sum(end - start for start, end in merge(zip(firsts or (), ends or ())))
                of = set(items or ())
                out.append((doc_id, n, hit, len(of), digest(of), len(of) >= min_items))
            yield _result(out)

    return joined.mapInArrow(fold, SCHEMA)


def _blocks(docs: DataFrame, pieces: Iterable[Search]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n_words) of all documents, and the hits of each distinct text with any.

    A text's hits follow from the text alone, so equal texts share them: a block's are made distinct
    before they are gathered, which leaves at most one row a text and block.
    """
    spark = docs.sparkSession
    text = F.col("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(text).alias("text_key"), text.cast("binary").alias("text"))
    path = common.scratch(spark, "hits")
    for number, piece in enumerate(pieces):
        keyed.mapInArrow(_hits(piece, every=not number), _HITS).write.parquet(f"{path}/{number}")
    rows = spark.read.schema(_HITS).parquet(f"{path}/0").select("doc_id", "text_key", "n_words")
    every = spark.read.schema(_HITS).parquet(*(f"{path}/{i}" for i in range(number + 1)))
    parts = ("firsts", "ends", "items")
    hits = (
        every.filter(F.size("items") > 0)
        .select("text_key", *parts)
        .distinct()
        .groupBy(F.col("text_key").alias("hit_key"))
        .agg(*(F.flatten(F.collect_list(c)).alias(c) for c in parts))
    )
    return rows, hits


def remove(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_items: int = LEAK_ITEMS, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """The documents with windows of fewer than min_items items, with all their columns.

    Each row is judged by its own text, whatever its id and however many blocks the benchmark has:
    the verdicts of a benchmark of several blocks are joined back by the text's digest.
    """
    common.prepare(docs.sparkSession)
    pieces = searches(benchmark, width, block_windows)
    first, second = next(pieces, Search([])), next(pieces, None)
    if second is not None:
        bad = common.fresh(docs, "__bad")
        _, hits = _blocks(docs, itertools.chain([first, second], pieces))
        verdicts = hits.filter(F.size(F.array_distinct("items")) >= min_items).select(F.col("hit_key").alias(bad))
        return docs.join(verdicts, common.text_key(docs["text"]) == F.col(bad), "left_anti")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            keep = [len(first.document(words(text))[1]) < min_items for text in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
