"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, the consecutive pieces of PASSAGE bytes of its whole text. A
passage is encoded from the frequencies of its neighbouring byte classes and of repeats of earlier
text by a learnt layer; gated attention weights, learnt from document labels alone, sum the passage
codes to one representation, which a logistic layer scores.

Defined results: a null or empty text is one passage without anything in it, and is scored so;
labels other than 0 and 1 and null ids are left out; a document with several labels counts with the
smallest; of training rows that share an id one counts; without training rows of both labels every score is the share of label 1 (0.5 without any
row); repeated rows are answered one by one; only doc_id, text and labels' doc_id and quality are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common

#: Bytes of a passage, and the score from which label 1 is predicted.
PASSAGE, THRESHOLD = 512, 0.7
#: Labelled rows that the model is fitted on at most, and their passages in all: rows are taken whole, by a
#: hash of the id, and one that would pass that number is left out.
SAMPLE, FIT_PASSAGES = 4000, 100_000
#: Width of the passage code and of the attention layers; passes over the sample, rows of a step.
CODE, ATTENTION, EPOCHS, STEP, RATE = 32, 16, 24, 128, 4e-3
#: Passages of a text whose features are held at once: a longer text is pooled piece by piece.
PIECE = 4096
#: Grams that are sorted at once when repeats are looked for; more are dealt into parts by a hash.
SORTED = 1 << 21

#: The class of each byte. 0 is a to z, 13 any byte of a non-ASCII character.
CLASSES = 16


def _byte_classes() -> np.ndarray:
    table = np.full(256, 14, np.uint8)
    for chars, number in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1),
        (b"0123456789", 2),
        (b" ", 3),
        (b"\n\r", 4),
        (b".", 5),
        (b",", 6),
        (b";:!?'\"()", 7),
        (b"|", 8),
        (b"#", 9),
        (b"$", 10),
        (b"%&*", 11),
        (b"<>{}[]/\\=_", 12),
        (b"\t\x00\x0b\x0c", 15),
        (b"abcdefghijklmnopqrstuvwxyz", 0),
    ):
        table[list(chars)] = number
    table[128:] = 13
    return table


FEATURES = CLASSES * CLASSES + 2
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_passages long, most_attention double"


def _grams(body: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, 8)).view("<u8")[:, 0]


def repeats(body: np.ndarray) -> np.ndarray:
    """Whether the eight bytes at each offset came before in the text, overlaps included."""
    n = max(0, len(body) - 7)
    again = np.ones(n, bool)
    parts = -(-n // SORTED)
    for part in range(parts):
        grams, places = [], []
        for at in range(0, n, SORTED):
            own = _grams(body[at : at + SORTED + 7])
            dealt = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == np.uint64(part)
            grams.append(own[dealt])
            places.append(np.flatnonzero(dealt) + at)
        again[np.concatenate(places)[np.unique(np.concatenate(grams), return_index=True)[1]]] = False
    return again


def passages(text: bytes | None) -> int:
    return max(1, -(-len(text or b"") // PASSAGE))


def pieces(text: bytes | None, table: np.ndarray) -> Iterator[np.ndarray]:
    """Feature rows of a text's passages, PIECE of them at a time."""
    body = np.frombuffer(text or b"", np.uint8)
    again = repeats(body)
    for begin in range(0, passages(text), PIECE):
        piece = body[begin * PASSAGE : (begin + PIECE) * PASSAGE + 1]
        many = min(PIECE, passages(text) - begin)
        out = np.zeros((many, FEATURES), np.float32)
        if len(piece) > 1:
            classes = table[piece].astype(np.int32)
            at = np.arange(len(piece) - 1) // PASSAGE
            pairs = at * (CLASSES * CLASSES) + classes[:-1] * CLASSES + classes[1:]
            counts = np.bincount(pairs, minlength=many * CLASSES * CLASSES).reshape(many, -1)
            out[:, :-2] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        own = again[begin * PASSAGE : (begin + PIECE) * PASSAGE]
        part = np.arange(len(own)) // PASSAGE
        out[:, -2] = np.bincount(part, own, minlength=many) / np.maximum(np.bincount(part, minlength=many), 1)
        out[:, -1] = 1.0 if len(body) else 0.0
        yield out


def encode(texts: list[bytes | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the number of passages of each text."""
    rows = [piece for text in texts for piece in pieces(text, table)]
    return np.concatenate(rows) if rows else np.zeros((0, FEATURES), np.float32), np.array([passages(t) for t in texts], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Passage layer, gated attention and the logistic layer."""

    def __init__(self, share: float):
        self.share, self.fitted = share, False

    def _start(self, rows: np.ndarray) -> None:
        rng = np.random.default_rng(7)
        self.mean = rows.mean(0)
        self.scale = 1 / (rows.std(0) + 0.02)

        def layer(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "w": layer(FEATURES, CODE),
            "b": np.zeros(CODE, np.float32),
            "v": layer(CODE, ATTENTION),
            "u": layer(CODE, ATTENTION),
            "a": layer(ATTENTION, 1),
            "c": layer(CODE, 1),
            "d": np.zeros(1, np.float32),
        }

    def _passages(self, rows: np.ndarray) -> tuple:
        """Inputs, codes, the attention's two parts and its logit of each passage."""
        p = self.p
        x = (rows - self.mean) * self.scale
        code = np.maximum(x @ p["w"] + p["b"], 0)
        tanh, gate = np.tanh(code @ p["v"]), _sigmoid(code @ p["u"])
        return x, code, tanh, gate, ((tanh * gate) @ p["a"])[:, 0]

    def _forward(self, rows: np.ndarray, starts: np.ndarray, bags: np.ndarray) -> dict:
        p = self.p
        x, code, tanh, gate, logit = self._passages(rows)
        logit = np.exp(logit - np.maximum.reduceat(logit, starts)[bags])
        weight = logit / np.add.reduceat(logit, starts)[bags]
        pooled = np.add.reduceat(weight[:, None] * code, starts)
        score = _sigmoid(pooled @ p["c"] + p["d"])[:, 0]
        return {"x": x, "code": code, "tanh": tanh, "gate": gate, "weight": weight, "pooled": pooled, "score": score}

    def _gradients(self, f: dict, labels: np.ndarray, starts: np.ndarray, bags: np.ndarray) -> dict:
        p, n = self.p, len(labels)
        error = ((f["score"] - labels) / n)[:, None].astype(np.float32)
        g = {"c": f["pooled"].T @ error, "d": error.sum(0)}
        pooled = (error @ p["c"].T)[bags]
        code = f["weight"][:, None] * pooled
        by = (pooled * f["code"]).sum(1)
        logit = f["weight"] * (by - np.add.reduceat(f["weight"] * by, starts)[bags])
        both = logit[:, None] @ p["a"].T
        g["a"] = (f["tanh"] * f["gate"]).T @ logit[:, None]
        tanh = both * f["gate"] * (1 - f["tanh"] ** 2)
        gate = both * f["tanh"] * f["gate"] * (1 - f["gate"])
        g["v"], g["u"] = f["code"].T @ tanh, f["code"].T @ gate
        code = (code + tanh @ p["v"].T + gate @ p["u"].T) * (f["code"] > 0)
        g["w"], g["b"] = f["x"].T @ code, code.sum(0)
        return g

    def fit(self, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the log loss of the bags."""
        self._start(rows)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        rng = np.random.default_rng(11)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        turn = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), STEP):
                chosen = order[at : at + STEP]
                picked = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in chosen])
                starts = np.concatenate([[0], np.cumsum(sizes[chosen])[:-1]])
                bags = np.repeat(np.arange(len(chosen)), sizes[chosen])
                forward = self._forward(rows[picked], starts, bags)
                turn += 1
                for k, g in self._gradients(forward, labels[chosen], starts, bags).items():
                    g = g + 1e-4 * self.p[k]
                    m, s = moments[k]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    self.p[k] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
        self.fitted = True

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and the greatest attention weight in it."""
        if not self.fitted or not len(sizes):
            return np.full(len(sizes), self.share), np.ones(len(sizes))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        forward = self._forward(rows, starts, np.repeat(np.arange(len(sizes)), sizes))
        return forward["score"].astype(float), np.maximum.reduceat(forward["weight"], starts).astype(float)


    def score_long(self, text: bytes, table: np.ndarray) -> tuple[float, float]:
        """score() of one text, of which only a piece is held at a time: the attention's sums are carried on."""
        if not self.fitted:
            return self.share, 1.0
        top, total, pooled = -np.inf, 0.0, 0.0
        for rows in pieces(text, table):
            _, code, _, _, logit = self._passages(rows)
            most = max(top, float(logit.max()))
            weight = np.exp(logit - most)
            total = total * np.exp(top - most) + weight.sum()
            pooled = pooled * np.exp(top - most) + weight @ code
            top = most
        score = _sigmoid(pooled / total @ self.p["c"] + self.p["d"])
        return float(score[0]), float(1 / total)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FIT_PASSAGES) -> Model:
    """Learn from at most `sample` labelled rows of the training folds, whole, of `most` passages in all."""
    spark = common.prepare(docs.sparkSession)
    chosen = common.sampled_labels(labels, "quality", sample)
    if not chosen:
        return Model(0.5)
    ids, marks = zip(*chosen)
    marked = spark.createDataFrame(pa.table({"__id": pa.array(ids, pa.int64()), "label": pa.array(marks, pa.int32())}))

    path = common.scratch(spark, "quality")
    doc_id = F.col("doc_id").cast("long")
    labelled = docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text")).join(
        F.broadcast(marked), F.col("doc_id") == F.col("__id")  # at most `sample` rows
    )
    common.one_each(labelled, "label").write.parquet(path)
    rows = spark.read.schema("doc_id long, text binary, label int").parquet(path)
    many = {r.doc_id: max(1, -(-(r.n or 0) // PASSAGE)) for r in rows.select("doc_id", F.octet_length("text").alias("n")).collect()}
    used, left = [], most
    for i in ids:  # by the hash of the id
        if i in many and many[i] <= left:
            used.append(i)
            left -= many[i]
    if not used:
        return Model(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_classes()
        for batch in batches:
            out = [encode([text], table)[0].tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "label", "rows"]
            )

    found = rows.filter(F.col("doc_id").isin(used)).mapInArrow(run, "doc_id long, label int, rows binary").toArrow()
    found = sorted(zip(*(found.column(i).to_pylist() for i in range(3))))
    bags = [np.frombuffer(rows, np.float32).reshape(-1, FEATURES) for _, _, rows in found]
    target = np.array([label for _, label, _ in found], np.float32)
    model = Model(float(target.mean()))
    if 0 < target.mean() < 1:
        model.fit(np.concatenate(bags), np.array([len(bag) for bag in bags]), target)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, its passages and its greatest attention."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_classes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = np.array([passages(text) for text in texts], np.int64)
            scores, most = np.zeros(len(texts)), np.zeros(len(texts))
            ends = np.cumsum(np.minimum(sizes, PIECE + 1))  # a long text begins a run of its own
            for run_ in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // PIECE)) + 1):
                short = run_[sizes[run_] <= PIECE]
                scores[short], most[short] = model.score(*encode([texts[i] for i in short], table))
                for i in run_[sizes[run_] > PIECE]:
                    scores[i], most[i] = model.score_long(texts[i], table)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype(np.int32), pa.int32()),
                    pa.array(sizes, pa.int64()),
                    pa.array(most, pa.float64()),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_passages", "most_attention"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), common.held_out(doc_id).alias("held_out"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(run, SCHEMA)
