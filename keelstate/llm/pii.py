"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans.

Base spans are the leftmost non-overlapping matches of each kind's pattern, found in time linear in
the text. The tagger labels blank-separated words from word-shape features of a word and of the
two words on either side. Where no run of inside labels through a word can gain over leaving the run outside, the
word is outside for certain; Viterbi runs, in numpy over many chains at once, only on the runs of
words between such words, with the same result as on all.

Defined results: a null or empty text has no spans; base spans always stay, tagged spans that touch
one are dropped, and so are tagged spans that can't be of their kind (valid()); repeated rows are answered one by one; an empty table gives no rows; only doc_id
and text are read (redaction also rewrites n_chars if it is there), so other columns may have any
name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common
from keelstate.llm.pii_table import ROWS, more

#: Kinds in the order in which spans of one start stand; the last two come from the tagger alone.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "id")
_RANK = {kind: i for i, kind in enumerate(KINDS)}
#: Weight of the squared weights, steps and rate of the training; words kept at hand by a task.
PENALTY, TURNS, RATE, MEMORY = 0.02, 160, 0.15, 1 << 17
#: Feature sets from which on a task starts its table anew before the next batch.
LIMIT = 1 << 15

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The characters before an @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9][0-9.\x20-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\S+")
#: An address with its marks spelt out, or with an @ that the base pattern doesn't take.
_SPELT = re.compile(r"\S\s?@\s?\S|\S\s+[(<\[]?at[)>\]]?\s+\S+(?:\s+\S+)*\s+[(<\[]?dot[)>\]]?\s+\S", re.IGNORECASE)
_HEX = frozenset("0123456789abcdef")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the base patterns, in their order."""
    found = list(_emails(text)) if "@" in text else []
    for run in _NUMBERS.finditer(text):
        first, last = run.span()
        if last - first < 7:
            continue
        for m in _IP.finditer(text, first, last):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text, first, last):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple:
    return span[0], _RANK[span[2]], span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


#: Words that stand before personal data.
_CUES = frozenset(
    "mail e-mail email contact write reach courriel correo at dot phone call tel mobile fax number telefon ssn social security "
    "passport iban card credit mr mrs ms dr prof herr frau monsieur madame name ip host client server address".split()
)
_LONGEST = max(map(len, _CUES))
_TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame name".split())
_IDS = frozenset("ssn security passport iban no number".split())
_RUNS = re.compile(r"(.)\1+")


def _shape(c: str) -> str:
    if c.isdigit():
        return "0"
    if c.isalpha():
        return "a" if c.islower() else "A" if c.isupper() else "l"
    return c if c in "@+-.:()=/_|#$%&*\"" else "."


_SHAPES = {c: _shape(chr(c)) for c in range(128)}


def features(word: str) -> tuple[str, ...]:
    """Shape features of one word."""
    core = word.strip(".,;:!?\"'()[]")
    low = core.lower()
    shape = _RUNS.sub(r"\1", word.translate(_SHAPES) if word.isascii() else "".join(map(_shape, word)))
    digits = sum(map(str.isdigit, word))
    out = [
        "shape " + shape,
        f"digits {min(digits, 16) if digits < 5 else 5 + (digits >= 8) + (digits >= 12) + (digits >= 17)}",
        f"length {min(len(word) // 3, 6)}",
        "ends " + (word[-1] if word and not word[-1].isalnum() else "word"),
    ]
    if low in _CUES:  # a word around which personal data may stand
        out.append("cue " + ("title" if low in _TITLES else "id" if low in _IDS else low))
    if "@" in word:
        out.append("has @")
    if digits and digits == len(core):
        out.append(f"all digits {min(len(core), 17)}")
    if core[:1].isupper() and core[1:].islower() and core.isalpha():
        out.append("capital")
    return tuple(out)


def parse(rows: str | None = None) -> list[tuple[list[str], list[str]]]:
    """Words and labels of a labelled table, by default of the one that comes with the tagger; O is outside."""
    out = []
    for line in (f"{ROWS}{more()}" if rows is None else rows).strip().splitlines():
        words, labels = [], []
        for part in re.split(r"(\[[a-z]+\|[^\]]*\]\S*)", line):
            if m := re.fullmatch(r"\[([a-z]+)\|([^\]]*)\](\S*)", part):
                inner = (m[2] + m[3]).split()
                words += inner
                labels += [m[1]] * len(inner)
            else:
                words += part.split()
                labels += ["O"] * len(part.split())
        out.append((words, labels))
    return out


LABELS = ("O", *KINDS)
#: Places of the words whose features bear on a word, and empty places after a text that keep texts apart.
AROUND, GAP = (0, -1, 1, -2, 2), 2


class Tagger:
    """Weights of the field. Scores of a word are the sums of five parts: its own features and those of
    the words AROUND it; a change of label adds its transition weight."""

    def __init__(self, rows: list[tuple[list[str], list[str]]]):
        names = sorted({f for words, _ in rows for w in words for f in features(w)})
        self.names = {name: i for i, name in enumerate(names)}
        n, k = len(names), len(LABELS)
        chains = [([[self.names[f] for f in features(w)] for w in words], [LABELS.index(x) for x in labels]) for words, labels in rows]
        #: Rows of the design: a word's features at part 0, those of the words around it at the parts after.
        design, ends, target = [], [], []
        for chain, labels in chains:
            for i in range(len(chain)):
                row = np.zeros(len(AROUND) * n, np.float32)
                for part, away in enumerate(AROUND):
                    if 0 <= i + away < len(chain):
                        row[[part * n + f for f in chain[i + away]]] = 1
                design.append(row)
            target += labels
            ends.append(len(target))
        design, target = np.array(design), np.array(target)
        weights, change = np.zeros((len(AROUND) * n, k), np.float32), np.zeros((k, k))
        moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(change), np.zeros_like(change)]
        wanted, wanted_change = design.T @ np.eye(k, dtype=np.float32)[target], np.zeros((k, k))
        starts = [0, *ends[:-1]]
        for start, end in zip(starts, ends):
            np.add.at(wanted_change, (target[start : end - 1], target[start + 1 : end]), 1)
        lengths = np.diff([0, *ends])
        padded = np.zeros((len(ends), max(lengths), k))
        inside = np.arange(max(lengths)) < lengths[:, None]
        for turn in range(1, TURNS + 1):
            padded[inside] = design @ weights
            shares, pairs = self.marginals(padded, lengths, change)
            share = shares[inside].astype(np.float32)
            for at, (x, g) in enumerate(((weights, wanted - design.T @ share), (change, wanted_change - pairs))):
                g = g - PENALTY * x * 10
                m, s = moments[2 * at], moments[2 * at + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x += RATE * (1 - turn / (TURNS + 1)) * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)
        self.parts = weights.reshape(len(AROUND), n, k)
        self.change = change
        #: The most that entering a label gains over staying outside, and leaving one.
        self.enter = change[:, 1:].max(0) - change[0, 0]
        self.leave = max(0.0, (change[1:, 0] - change[0, 0]).max())

    def undecided(self, scores: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words that some best labelling may put inside.

        A run of inside words gains at most the sum of its words' bounds over leaving it outside.
        A word is outside for certain if no run through it has a bound over 0; the best run through
        each word comes from running sums. Texts are kept apart by their gaps.
        """
        above = scores[:, 1:] - scores[:, :1]
        bound = (above + self.enter).max(1).astype(np.float64)
        first = starts[starts < ends]
        bound[first] = (above[first] + np.maximum(self.enter, 0)).max(1)
        for i in range(GAP):
            bound[ends + i] = -1e6
        total = np.cumsum(bound)
        before = np.concatenate([[0.0], total[:-1]])
        upto = total - np.minimum.accumulate(before)
        onward = np.maximum.accumulate(total[::-1])[::-1] - before
        return np.flatnonzero(upto + onward - bound + self.leave > -1e-3)

    @staticmethod
    def marginals(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label shares of each word and expected transitions of padded chains, by the forward and backward sums."""
        n, longest, k = scores.shape
        inside = np.arange(longest) < lengths[:, None]
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for i in range(1, longest):
            x = forward[:, i - 1, :, None] + change
            top = x.max(1)
            forward[:, i] = scores[:, i] + top + np.log(np.exp(x - top[:, None]).sum(1))
        for i in range(longest - 2, -1, -1):
            x = change + (scores[:, i + 1] + backward[:, i + 1])[:, None]
            top = x.max(2)
            backward[:, i] = np.where(inside[:, i + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), 0)
        last = forward[np.arange(n), lengths - 1]
        top = last.max(1)
        total = top + np.log(np.exp(last - top[:, None]).sum(1))
        shares = np.where(inside[..., None], np.exp(np.minimum(forward + backward - total[:, None, None], 0)), 0)
        pairs = np.zeros((k, k))
        for i in range(1, longest):
            x = forward[:, i - 1, :, None] + change + (scores[:, i] + backward[:, i])[:, None] - total[:, None, None]
            pairs += np.exp(np.minimum(x, 0))[inside[:, i]].sum(0)
        return shares, pairs

    @classmethod
    def _marginals(cls, scores: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """marginals() of one chain."""
        shares, pairs = cls.marginals(scores[None], np.array([len(scores)]), change)
        return shares[0], pairs

    def word_scores(self, key: tuple[str, ...]) -> np.ndarray:
        """(parts, labels): what a word of these features adds to itself and to the words that it is around."""
        found = [self.names[f] for f in key if f in self.names]
        return self.parts[:, found].sum(1).astype(np.float32)


def viterbi(scores: list[np.ndarray], change: np.ndarray) -> list[np.ndarray]:
    """Best labels of many chains, those of one length decoded together."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
    by_length: dict[int, list[int]] = {}
    for i, chain in enumerate(scores):
        by_length.setdefault(len(chain), []).append(i)
    for length, rows in by_length.items():
        batch = np.stack([scores[i] for i in rows])
        best, back = batch[:, 0], []
        for t in range(1, length):
            x = best[:, :, None] + change[None]
            back.append(x.argmax(1))
            best = x.max(1) + batch[:, t]
        labels = np.zeros((len(rows), length), int)
        labels[:, -1] = best.argmax(1)
        for t in range(length - 2, -1, -1):
            labels[:, t] = back[t][np.arange(len(rows)), labels[:, t + 1]]
        for row, i in enumerate(rows):
            out[i] = labels[row]
    return out


class Decoder:
    """A tagger with the scores of the words that it has seen."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.change = tagger, tagger.change.astype(np.float32)
        self.clear()

    def clear(self) -> None:
        #: Row 0 stands for no word: before the first and after the last of a text.
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((1024, len(AROUND), len(LABELS)), np.float32)
        self.kinds: dict[tuple, int] = {}
        #: Rows of plain words by first letter's case, size and last mark.
        self.plain = {
            (upper, size, mark): self._row(features(("A" if upper else "a") + "a" * (3 * size) + mark)[:2] + (f"length {size}",) + tail)
            for upper in (False, True)
            for size in range(7)
            for mark in ("", ".", ",")
            for tail in [("ends " + (mark or "word"), *(("capital",) if upper else ()))]
        }

    def _row(self, key: tuple[str, ...]) -> int:
        """The row of a feature set: words of the same known features share it, so the table stays small."""
        key = tuple(f for f in key if f in self.tagger.names)
        row = self.kinds.get(key)
        if row is None:
            row = self.kinds[key] = len(self.kinds) + 1
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = self.tagger.word_scores(key)
        return row

    def _learn(self, word: str) -> int:
        mark = word[-1] if word[-1] in ".," else ""
        body = word[:-1] if mark else word
        if len(body) > 2 and body.isalpha() and body[1:].islower() and (len(body) > _LONGEST or body.lower() not in _CUES):
            row = self.plain[body[0].isupper(), min(len(word) // 3, 6), mark]
        else:
            row = self._row(features(word))
        if len(self.numbers) < MEMORY:
            self.numbers[word] = row
        return row

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Label scores of all words, and where each text starts among them (GAP empty places after each text)."""
        if len(self.kinds) > LIMIT:
            self.clear()
        get, learn = self.numbers.get, self._learn
        rows: list[int] = []
        starts = []
        for words in texts:
            starts.append(len(rows))
            rows += [get(word) or learn(word) for word in words]
            rows += [0] * GAP
        at = np.array(rows, np.int64)
        scores = self.table[at, 0]
        for part, away in enumerate(AROUND[1:], 1):
            if away < 0:
                scores[-away:] += self.table[at[:away], part]
            else:
                scores[:-away] += self.table[at[away:], part]
        scores[at == 0] = 0
        return scores, np.array(starts, np.int64)

    def tag(self, texts: list[list[str]]) -> list[list[tuple[int, int, str]]]:
        """Per text the maximal runs (first word, end, kind) of equal labels other than O."""
        if not texts:
            return []
        scores, starts = self.scores(texts)
        ends = np.append(starts[1:], len(scores)) - GAP
        places = self.tagger.undecided(scores, starts, ends)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(places):
            return out
        cuts = np.flatnonzero(np.diff(places) > 1) + 1
        runs = [(int(part[0]), int(part[-1]) + 1) for part in np.split(places, cuts)]
        of = np.searchsorted(starts, [first for first, _ in runs], "right") - 1
        chains = []
        for (first, end), text in zip(runs, of.tolist()):
            chain = scores[first:end].copy()
            if first > starts[text]:
                chain[0] += self.change[0]  # the word before is O
            if end < ends[text]:
                chain[-1] += self.change[:, 0]  # so is the word after
            chains.append(chain)
        for (first, _), text, labels in zip(runs, of.tolist(), viterbi(chains, self.change)):
            first -= int(starts[text])
            begin = 0
            for i in range(1, len(labels) + 1):
                if i == len(labels) or labels[i] != labels[begin]:
                    if labels[begin]:
                        out[text].append((first + begin, first + i, LABELS[labels[begin]]))
                    begin = i
        return out


def valid(piece: str, kind: str) -> bool:
    """Whether a piece can be of a kind at all: the definition of the kind, whatever stands around it."""
    digits = _NOT_DIGIT.sub("", piece)
    if kind == "email":
        return bool(_SPELT.search(piece))
    if kind == "ip":
        return piece.count(":") >= 2 and all(len(x) <= 4 and set(x.lower()) <= _HEX for x in piece.split(":"))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in piece)
    if kind == "id":
        return len(digits) >= 6
    return not digits and all(word[0].isupper() for word in piece.split())


def spans(texts: list[str], decoder: Decoder) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    out = []
    for text, runs in zip(texts, decoder.tag([text.split() for text in texts])):
        base = base_spans(text)
        every = list(base)
        if runs:
            places = [m.span() for m in _WORD.finditer(text)]
            taken = [(s, e) for s, e, _ in base]
            for first, end, kind in runs:
                start, stop = places[first][0], places[end - 1][1]
                piece = text[start:stop]
                start += len(piece) - len(piece.lstrip(",;:!?\"'[]{}<>=|#$%&*"))
                stop -= len(piece) - len(piece.rstrip(".,;:!?\"'[]{}<>=|#$%&*"))
                if start < stop and valid(text[start:stop], kind) and not any(s < stop and start < e for s, e in taken):
                    every.append((start, stop, kind))
                    taken.append((start, stop))
            every.sort(key=_order)
        out.append((base, every))
    return out


def train(rows: str | None = None) -> Tagger:
    """The tagger of a labelled table, by default of the one that comes with it."""
    return Tagger(parse(rows))


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tagger)
        for batch in batches:
            found = spans([text or "" for text in batch.column(1).to_pylist()], decoder)
            numbers = [[sum(kind == k for _, _, kind in base) for base, _ in found] for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(n, pa.int64()) for n in numbers),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(every) for _, every in found], pa.string()),
                ],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redacted(text: str, every: list[Span]) -> str:
    """The text with each group of overlapping spans replaced by the first one's kind."""
    parts, done = [], 0
    for start, end, kind in every:
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars, if there, counts the new text."""
    common.prepare(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tagger)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = spans([text or "" for text in texts], decoder)
            new = [text if not every else redacted(text, every) for text, (_, every) in zip(texts, found)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if counted is not None:
                kept = columns[counted].to_pylist()
                sizes = [n if not every else len(text) for n, text, (_, every) in zip(kept, new, found)]
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
