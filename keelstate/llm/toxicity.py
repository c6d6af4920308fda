"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

An example or a query is the TF-IDF vector of its terms, among them the most common ones, so that
nearly every text has neighbours. Terms that go with the label by a chi-square test over the sampled
training rows, and by their share of toxic rows, which terms that merely come with longer texts don't
pass, weigh in full; the others' IDF counts a small part. Examples stand in a block-max inverted
index: a term's postings are cut at blocks of examples, each with its greatest weight, so that a
query bounds every block and reads the postings only of blocks that can still hold one of the k
nearest. The neighbours vote with weights that fall with their distance; votes are calibrated by
isotonic regression on the left-out votes of examples that took no part in choosing the terms. The
neighbours are the evidence.

Defined results: a null, empty or term-less text gets the share of toxic rows among term-less
examples and no evidence; labels other than 0 and 1 and null ids are left out; a document with
several labels counts with the smallest; of training rows that share an id one counts; without
training rows every score is 0; equal similarities go to the example with the smaller doc_id;
repeated rows are answered one by one; only doc_id, text and labels' doc_id and toxic are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common

#: Labelled rows that the classifier is fitted on at most, and terms of either kind that it keeps at most.
SAMPLE, TERMS = 20000, 4000
#: What the IDF of a term that doesn't go with the label is multiplied by, and the share of rows that may hold it.
COMMON, SPREAD = 0.05, 0.1
#: A term goes with the label from this chi-square value, number of rows, and share of toxic rows over the overall
#: one on; any other term is kept from COMMON_ROWS on.
CHI_SQUARE, MIN_ROWS, LIFT, COMMON_ROWS = 20.0, 5, 2.0, 2
#: Of ten parts of the sample those that choose the terms; the others calibrate the votes.
CHOOSING = 8
#: Neighbours, examples of a block, and the score from which a document is toxic.
NEIGHBOURS, BLOCK, THRESHOLD = 15, 64, 0.3
#: Blocks that a query reads before it knows which others it must; each further round reads MORE times as many.
FIRST, MORE = 8, 4
#: Distance at which a vote's weight is halved, and the weight of the overall share in a vote.
HALF, PRIOR = 0.1, 0.5
#: Texts whose answers a task keeps at hand.
MEMORY = 1 << 13

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, similarities array<double>"

#: In ASCII texts all but the letters separates words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_LETTERS).decode().split()
    return _WORD.findall(text.lower())


class Index:
    """Distinct example vectors, each with its examples' ids and labels, by terms and blocks."""

    def __init__(self, vectors: dict[tuple, list[tuple[int, int]]], idf: np.ndarray):
        self.idf = idf
        # Vectors with the same leading terms stand together, which keeps block maxima tight.
        keys = sorted(vectors, key=lambda key: ([t for t, _ in sorted(key, key=lambda x: (-idf[x[0]] * (1 + math.log(x[1])), x[0]))[:4]], key))
        self.ids = [min(i for i, _ in vectors[key]) for key in keys]
        self.count = np.array([len(vectors[key]) for key in keys], float)
        self.toxic = np.array([sum(y for _, y in vectors[key]) for key in keys], float)
        self.keys = {key: i for i, key in enumerate(keys)}
        self.tie = np.argsort(np.argsort(np.array(self.ids, np.int64), kind="stable"), kind="stable")
        self.blocks = -(-len(keys) // BLOCK)
        weighed = [self.weigh(key) for key in keys]
        terms = np.concatenate([t for t, _ in weighed] or [np.zeros(0, np.int64)])
        rows = np.repeat(np.arange(len(keys)), [len(t) for t, _ in weighed])
        order = np.lexsort((rows, terms))
        #: Postings by term, then row; where those of a term's block begin; and the greatest weight there.
        self.rows, self.weights = rows[order].astype(np.int32), np.concatenate([w for _, w in weighed] or [np.zeros(0)])[order]
        place = terms[order] * self.blocks + self.rows // BLOCK
        self.edges = np.searchsorted(place, np.arange(len(idf) * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros(len(idf) * self.blocks)
        if len(place):
            firsts = np.flatnonzero(np.diff(place, prepend=-1))
            self.most[place[firsts]] = np.maximum.reduceat(self.weights, firsts)
        self.most = self.most.reshape(len(idf), self.blocks)
        self.most = self.most.astype(np.float32) * np.float32(1 + 1e-5)  # rounded up: sums of it stay bounds
        #: Postings that queries have read, those of their terms that they haven't had to, and runs that the former lay in.
        self.read = self.skipped = self.runs = 0

    def __getstate__(self) -> dict:
        """What tasks need: the vectors themselves stay with the driver."""
        return self.__dict__ | {"keys": {}}

    def weigh(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit TF-IDF vector."""
        terms = np.array([term for term, _ in key], np.int64)
        weights = (1 + np.log([n for _, n in key])) * self.idf[terms]
        return terms, weights / np.sqrt((weights**2).sum())

    def nearest(self, key: tuple, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k nearest distinct vectors with similarity over 0, nearest first."""
        if not key or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, weights = self.weigh(key)
        bound = weights.astype(np.float32) @ self.most[terms]
        waiting = np.argsort(-bound, kind="stable")
        waiting = waiting[: np.searchsorted(-bound[waiting], -1e-300, "right")]
        near, sims, least, many, read = np.zeros(0, np.int64), np.zeros(0), 1e-300, FIRST, 0
        while len(waiting):
            rows, found, touched = self._score(terms, weights, waiting[:many])
            read += touched
            keep = (found >= max(least - 1e-11, 1e-300)) & (rows != without)
            near, sims = np.concatenate([near, rows[keep]]), np.concatenate([sims, found[keep]])
            if len(sims) > k:  # rows that can't be among the k nearest go
                least = np.partition(sims, -k)[-k]
                keep = sims >= least - 1e-11
                near, sims = near[keep], sims[keep]
            waiting, many = waiting[many:], MORE * many
            waiting = waiting[bound[waiting] >= least - 1e-11]
        self.read += read
        self.skipped += int((self.edges[(terms + 1) * self.blocks] - self.edges[terms * self.blocks]).sum()) - read
        best = np.lexsort((self.tie[near], -np.round(sims, 12)))[:k]
        return near[best], np.minimum(sims[best], 1.0)

    def _score(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and exact similarities of some blocks, from the postings of these blocks alone."""
        blocks = np.sort(blocks)
        cuts = np.flatnonzero(np.diff(blocks) > 1) + 1
        firsts, lasts = blocks[np.concatenate([[0], cuts])], blocks[np.concatenate([cuts - 1, [-1]])]
        places = terms[:, None] * self.blocks  # a term's postings of adjacent blocks lie together
        starts = self.edges[places + firsts].ravel()
        sizes = self.edges[places + lasts + 1].ravel() - starts
        ends = np.cumsum(sizes)
        self.runs += len(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        found = self.weights[at]
        found *= np.repeat(weights, sizes.reshape(len(terms), -1).sum(1))
        rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        return rows, np.bincount(self.rows[at], found, minlength=self.blocks * BLOCK)[rows], len(at)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling adjacent violators."""
    pools: list[list[float]] = []  # [weighted mean, weight, first x, last x]
    for at in np.argsort(x, kind="stable").tolist():
        pools.append([y[at], weight[at], x[at], x[at]])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
    knots = [(first, mean) for mean, _, first, _ in pools] + [(last, mean) for mean, _, _, last in pools]
    knots.sort()
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    """Terms, index and calibration."""

    def __init__(
        self, terms: list[str], rows: list[tuple[int, int, tuple]], fresh: set[int] | None = None, common_from: int | None = None
    ):
        """rows: (doc_id, label, ((term number, count), ...)) of each example, by rising doc_id.

        fresh: the ids that took no part in choosing the terms, on which votes are calibrated (all, if not given).
        common_from: the place in terms from which they don't go with the label.
        """
        self.terms = {term: i + 1 for i, term in enumerate(terms)}
        vectors: dict[tuple, list[tuple[int, int]]] = {}
        held: Counter = Counter()
        for doc_id, label, key in rows:
            vectors.setdefault(key, []).append((doc_id, label))
            held.update(t for t, _ in key)
        fresh = {i for i, _, _ in rows} if fresh is None else fresh
        bare = [y for i, y in vectors.pop((), []) if i in fresh]
        self.share = sum(y for _, y, _ in rows) / max(1, len(rows))
        #: Of rows without terms; the overall share counts as one row.
        self.bare = (sum(bare) + self.share) / (len(bare) + 1)
        idf = np.array([0.0] + [math.log((1 + len(rows)) / (1 + held[i + 1])) + 1 for i in range(len(terms))])
        if common_from is not None:
            idf[common_from + 1 :] *= COMMON
        self.index = Index(vectors, idf)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        votes, shares, weights = [], [], []
        for key, row in self.index.keys.items():
            asked = [y for i, y in vectors[key] if i in fresh]
            if not asked:
                continue
            n, toxic = self.index.count[row], self.index.toxic[row]
            rows_, sims = self.index.nearest(key, NEIGHBOURS, without=row)
            for label, many in ((1, sum(asked)), (0, len(asked) - sum(asked))):
                if many:  # the example itself is left out, its equals are not
                    votes.append(self._vote(rows_, sims, (n - 1, toxic - label)))
                    shares.append(label)
                    weights.append(many)
        if len(votes) >= 20:
            self.knots = isotonic(np.array(votes), np.array(shares, float), np.array(weights, float))

    def _vote(self, rows: np.ndarray, sims: np.ndarray, equals: tuple[float, float] = (0, 0)) -> float:
        weight = HALF / (HALF + 1 - sims)
        total = PRIOR + equals[0] + (weight * self.index.count[rows]).sum()
        return (PRIOR * self.share + equals[1] + (weight * self.index.toxic[rows]).sum()) / total

    def key(self, found: list[str]) -> tuple:
        return tuple(sorted(Counter(filter(None, map(self.terms.get, found))).items()))

    def score(self, key: tuple) -> tuple[float, list[int], list[float]]:
        """Calibrated score, and ids and similarities of the neighbours."""
        if not key:
            return self.bare, [], []
        rows, sims = self.index.nearest(key, NEIGHBOURS)
        score = float(np.interp(self._vote(rows, sims), *self.knots))
        return min(1.0, max(0.0, score)), [self.index.ids[i] for i in rows], sims.tolist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each term: all and toxic ones, per batch."""
    for batch in batches:
        every: Counter = Counter()
        toxic: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set(words(text))
            every.update(found)
            if label:
                toxic.update(found)
        terms = list(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([every[t] for t in terms], pa.int64()), pa.array([toxic[t] for t in terms], pa.int64())],
            ["term", "n", "n_toxic"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Learn from at most `sample` labelled rows of the training folds.

    The bound holds for what reaches the driver too: ids, at most `terms` terms of either kind, and
    the rows' counts of those terms, one row for each id.
    """
    spark = common.prepare(docs.sparkSession)
    chosen = common.sampled_labels(labels, "toxic", sample)
    if not chosen:
        return Model([], [])
    ids, marks = zip(*chosen)
    marked = spark.createDataFrame(pa.table({"__id": pa.array(ids, pa.int64()), "label": pa.array(marks, pa.int32())}))
    path = common.scratch(spark, "toxicity")
    doc_id = F.col("doc_id").cast("long")
    labelled = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(marked), F.col("doc_id") == F.col("__id")  # at most `sample` rows
    )
    common.store(common.one_each(labelled, "label"), path)
    rows = spark.read.schema("doc_id long, text string, label int").parquet(path)
    choosing = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) < CHOOSING)
    n, n_toxic = choosing.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = n_toxic / max(1, n)
    least = min(LIFT * share, (1 + share) / 2)  # a share may be too high to be doubled
    a, b = F.col("n_toxic").cast("double"), (F.col("n") - F.col("n_toxic")).cast("double")
    c, d = n_toxic - a, (n - n_toxic) - b
    chi = n * F.pow(a * d - b * c, F.lit(2)) / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1e-9))
    counted = common.settled(
        choosing.select("text", "label")
        .mapInArrow(_counts, "term string, n long, n_toxic long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
        .filter(F.col("n") >= COMMON_ROWS)
        .withColumn("tells", (F.col("n") >= MIN_ROWS) & (chi >= CHI_SQUARE) & (F.col("n_toxic") >= least * F.col("n")))
        .withColumn("rank", F.when(F.col("tells"), chi).otherwise(F.col("n")))
        .filter(F.col("tells") | (F.col("n") <= SPREAD * n))
    )
    kept = [
        [row.term for row in counted.filter(which).orderBy(F.col("rank").desc(), "term").limit(terms).collect()] for which in ("tells", "not tells")
    ]
    model = Model([*kept[0], *kept[1]], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [model.key(words(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([[t for t, _ in key] for key in keys], pa.list_(pa.int32())),
                    pa.array([[n for _, n in key] for key in keys], pa.list_(pa.int32())),
                ],
                ["doc_id", "label", "terms", "counts"],
            )

    found = rows.mapInArrow(run, "doc_id long, label int, terms array<int>, counts array<int>").toArrow().combine_chunks()
    ids, marks, terms_of, counts_of = (found.column(i).combine_chunks() for i in range(4))
    ends = np.cumsum(terms_of.value_lengths().to_numpy()) if len(found) else []
    flat, many = terms_of.flatten().to_numpy(), counts_of.flatten().to_numpy()
    parts = zip(np.split(flat, ends[:-1]), np.split(many, ends[:-1]))
    known: dict[tuple, tuple] = {}  # equal pairs are held once
    examples = sorted(
        (i, y, tuple(known.setdefault(pair, pair) for pair in zip(t.tolist(), n.tolist())))
        for i, y, (t, n) in zip(ids.to_pylist(), marks.to_pylist(), parts)
    )
    del found, terms_of, counts_of, flat, many, parts, known
    chosen_by = {row.doc_id for row in choosing.select("doc_id").collect()}
    return Model([*kept[0], *kept[1]], examples, {i for i, _, _ in examples} - chosen_by, len(kept[0]))


def _scorer(model: Model):
    known: dict[bytes, tuple] = {}

    def score(text: str | None) -> tuple:
        digest = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if digest not in known:
            if len(known) >= MEMORY:
                known.clear()
            known[digest] = model.score(model.key(words(text)))
        return known[digest]

    return score


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every whole text."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model)
        for batch in batches:
            found = [of(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x[0] for x in found], pa.float64()),
                    pa.array([int(x[0] >= threshold) for x in found], pa.int32()),
                    pa.array([x[1] for x in found], pa.list_(pa.int64())),
                    pa.array([x[2] for x in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "score", "predicted", "neighbours", "similarities"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), common.held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model)
        for batch in batches:
            keep = [of(text)[0] < threshold for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
