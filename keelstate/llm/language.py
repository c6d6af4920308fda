"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression.

A text is the set of its letter n-grams of one to three symbols (a blended spectrum, by presence).
The kernel of two texts is the number of n-grams that they share over the geometric mean of their
own numbers. Landmarks chosen from the training texts give each text a feature vector, and one
ridge regression per language (one versus rest) scores it: all by matrix products per batch.

Defined results: a text that is null or has no letter is `und` with score 0; training rows with a
null id, text or language are left out; of those that share an id one counts; without any training row every text is `und`; repeated rows
are answered one by one; only doc_id, text and (to learn) lang are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common

#: Training rows that the model is fitted on at most, landmarks, and the ridge.
SAMPLE, LANDMARKS, RIDGE = 1500, 192, 1e-3
UNKNOWN = "und"
#: Symbols: 0 is anything but a letter, 1 to 26 are a to z, the others share the rest.
SYMBOLS, ORDER = 64, 3
#: One number for every n-gram: those of n symbols start where those of n - 1 end.
_STARTS = np.cumsum([0] + [SYMBOLS**n for n in range(1, ORDER + 1)])
GRAMS = int(_STARTS[-1])

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    points = np.arange(0x110000)
    letters = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table = np.where(letters, 27 + points % (SYMBOLS - 27), 0).astype(np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def mark_grams(text: str, table: np.ndarray, marks: np.ndarray) -> bool:
    """Set marks at the text's n-grams; False if it has no letter."""
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    if not codes.any():
        return False
    codes = np.concatenate([[0], codes, [0]]).astype(np.int32)
    gram = codes
    for n in range(ORDER):
        if n:
            gram = gram[:-1] * SYMBOLS + codes[n:]
        marks[gram + _STARTS[n]] = True
    marks[0] = False  # the gap alone says nothing
    return True


def grams(text: str, table: np.ndarray) -> np.ndarray:
    marks = np.zeros(GRAMS, bool)
    mark_grams(text, table, marks)
    return np.flatnonzero(marks).astype(np.int32)


class Model:
    """The fitted landmarks and regressions."""

    def __init__(self, sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        # Landmarks are dealt to the languages in turn, so that a rare one has some.
        by_lang = [[i for i, x in enumerate(langs) if x == lang] for lang in self.langs]
        turns = [group[turn] for turn in range(max(map(len, by_lang), default=0)) for group in by_lang if turn < len(group)]
        chosen = turns[:landmarks]
        self.vocabulary = np.unique(np.concatenate([sets[i] for i in chosen] or [np.zeros(0, np.int32)]))
        self.landmarks = np.zeros((len(self.vocabulary), len(chosen)), np.float32)
        for column, i in enumerate(chosen):
            self.landmarks[np.searchsorted(self.vocabulary, sets[i]), column] = 1 / np.sqrt(len(sets[i]))
        presence = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for row, found in enumerate(sets):
            presence[row] = np.isin(self.vocabulary, found, assume_unique=True)
        kernel = self._kernel(presence, np.array([len(found) for found in sets]))
        among = kernel[chosen].astype(np.float64)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        keep = values > 1e-6 * max(values.max(initial=0), 1e-9)
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = kernel @ root
        target = (np.array(langs)[:, None] == np.array(self.langs)[None]).astype(float) if langs else np.zeros((0, 0))
        weights = np.ones(len(langs))
        for lang in self.langs:  # each language weighs the same
            weights[np.array(langs) == lang] = len(langs) / len(self.langs) / langs.count(lang)
        gram = (features * weights[:, None]).T @ features + ridge * len(langs) * np.eye(features.shape[1])
        solved = np.linalg.solve(gram, (features * weights[:, None]).T @ target) if langs else np.zeros((0, 0))
        self.weights = (root @ solved).astype(np.float32)

    def _kernel(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return presence @ self.landmarks / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32)

    def scores(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Shares of the languages in each text's positive outputs."""
        out = np.clip(self._kernel(presence, sizes) @ self.weights, 1e-6, None).astype(np.float64)
        return out / out.sum(1, keepdims=True)

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        presence = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        sizes = np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            marks = np.zeros(GRAMS, bool)
            if text and mark_grams(text, table, marks):
                presence[row] = marks[self.vocabulary]
                sizes[row] = np.count_nonzero(marks)
        shares = self.scores(presence, sizes)
        best = shares.argmax(1)
        known = sizes > 0
        langs = [self.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist())]
        return langs, np.where(known, shares.max(1), 0.0).tolist()


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Learn from at most `sample` rows of the training folds, the first by a hash of the id.

    Their ids are chosen first, without reading the texts; n-grams are then taken on the executors,
    and sets of at most GRAMS numbers reach the driver, one for each id.
    """
    common.prepare(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.filter(F.col("lang").isNotNull() & doc_id.isNotNull() & ~common.held_out(doc_id))
    ids = rows.select(doc_id.alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow().column(0).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        for batch in batches:
            found = [grams(text, table) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "lang", "grams"]
            )

    chosen = rows.filter(doc_id.isin(ids) & F.col("text").isNotNull())
    one = common.one_each(chosen.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), "lang")
    learnt = one.mapInArrow(run, "doc_id long, lang string, grams array<int>").filter(F.size("grams") > 0).toArrow()
    order = np.argsort(learnt.column("doc_id").to_numpy())
    sets = [np.array(learnt.column("grams")[int(i)].values, np.int32) for i in order]
    return Model(sets, [learnt.column("lang")[int(i)].as_py() for i in order], landmarks)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        for batch in batches:
            langs, scores = model.predict(batch.column(2).to_pylist(), table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), common.held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
