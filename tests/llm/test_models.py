"""Toxicity, quality and language: the parts against brute force, the whole on held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelstate.llm import common, language, quality, toxicity
from tests.llm.conftest import ODD

LABELS = "doc_id long, quality int, toxic int, score double, label int"
BAD = ["scum", "idiot", "trash", "moron"]


def labelled(n=400):
    rng = random.Random(2)
    words = {"en": ["the", "of", "house", "water", "thing", "walk"], "de": ["der", "keit", "über", "haus", "wasser", "lich"]}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = rng.choices(words[lang], k=rng.randrange(20, 120))
        toxic = int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        poor = int(rng.random() < 0.3)
        body = " ".join(w + ("$$$" if poor else "") for w in text)
        rows.append((i, body, lang))
        labels.append((i, 1 - poor, toxic, None, None))
    return rows, labels


@pytest.fixture(scope="module")
def data(spark, frame):
    rows, labels = labelled()
    extra = [(None, 1, 1, None, None), (3, None, None, None, None), (99_999, 0, 0, None, None), (5, 7, 7, None, None)]
    return frame(rows), spark.createDataFrame(labels + extra, LABELS), rows, labels


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_fold(spark):
    got = spark.range(50).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == fold(r.id) for r in got) and any(r.h for r in got)


# toxicity


def test_toxicity_on_held_out_rows(data):
    docs, labels, rows, marks = data
    model = toxicity.fit(docs, labels)
    assert set(BAD) <= set(model.terms)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == fold(i) for i in got)
    assert all(got[i].predicted == int(got[i].score >= 0.3) and 0 <= got[i].score <= 1 for i in got)
    right = [got[i].predicted == y for i, _, y, _, _ in marks if fold(i)]
    assert sum(right) / len(right) > 0.97
    some = next(r for r in got.values() if r.predicted)
    assert some.neighbours and all(not fold(i) for r in got.values() for i in r.neighbours)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_index_equals_brute_cosine():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        n = rng.randrange(0, 6)
        rows.append((i, rng.randrange(2), tuple(sorted((t, rng.randrange(1, 4)) for t in rng.sample(range(1, 31), n)))))
    model = toxicity.Model([f"t{i}" for i in range(30)], rows)
    index = model.index
    keys = sorted(index.keys, key=index.keys.get)
    dense = np.zeros((len(keys), 31))
    for row, key in enumerate(keys):
        terms, weights = index.weigh(key)
        dense[row, terms] = weights
    for key in keys[::7]:
        sims = dense @ dense[index.keys[key]]
        got, found = index.nearest(key, 15)
        order = [i for i in np.lexsort((index.tie, -np.round(sims, 12))) if sims[i] > 0][:15]
        assert got.tolist() == order and np.allclose(found, np.minimum(sims[order], 1))


def test_postings_of_skipped_blocks_are_not_read():
    rng = random.Random(4)
    groups = [rng.sample(range(1, 401), 30) for _ in range(20)]
    rows = []
    for i in range(6000):
        group = groups[i % 20]
        rows.append((i, i % 2, tuple(sorted((t, rng.randrange(1, 3)) for t in rng.sample(group, 12)))))
    index = toxicity.Model([f"t{i}" for i in range(400)], rows).index
    index.read = index.skipped = 0
    for key in list(index.keys)[::50]:
        index.nearest(key, 15)
    asked = sum(int((index.weights[index.edges[t * index.blocks] : index.edges[(t + 1) * index.blocks]] > 0).sum()) for key in list(index.keys)[::50] for t, _ in key)
    assert index.read + index.skipped == asked and index.skipped > asked / 4


def test_postings_of_adjacent_blocks_are_read_in_one_run():
    rng = random.Random(8)
    rows = [(i, i % 2, tuple(sorted((t, rng.randrange(1, 3)) for t in rng.sample(range(1, 61), 9)))) for i in range(1500)]
    index = toxicity.Model([f"t{i}" for i in range(60)], rows).index
    keys = list(index.keys)
    dense = np.zeros((index.blocks * toxicity.BLOCK, 61))
    for row, key in enumerate(keys):
        terms, weights = index.weigh(key)
        dense[row, terms] = weights
    for blocks, runs in ((range(index.blocks), 1), ([5, 3, 4], 1), ([9, 2, 1, 7], 3), ([index.blocks - 1], 1)):
        terms, weights = index.weigh(keys[77])
        index.runs = 0
        got, sims, read = index._score(terms, weights, np.array(blocks))
        assert index.runs == runs * len(terms)
        assert sorted(got) == sorted(r for b in blocks for r in range(b * toxicity.BLOCK, (b + 1) * toxicity.BLOCK))
        want = dense[got][:, terms]
        assert np.allclose(sims, want @ weights) and read == (want > 0).sum()


def test_nearly_every_text_has_neighbours(spark, sf_dir):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i"))
    bare, every = got.filter("trim(text) <> ''").agg(F.count_if(F.size("neighbours") == 0), F.count("*")).first()
    assert bare < 0.01 * every


def test_an_id_that_repeats_is_learnt_from_once(spark, frame, data):
    docs, labels, rows, _ = data
    many = frame(rows + [rows[0]] * 300 + [(rows[0][0], "other text", "de")] * 5)
    assert len(toxicity.fit(many, labels).index.ids) <= len(rows)
    assert sum(toxicity.fit(many, labels).index.count) <= len(rows)
    assert language.fit(many).langs == ["de", "en"] and quality.fit(many, labels).fitted


def test_isotonic():
    x, y = np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0.0, 1.0, 0.0, 0.2, 1.0])
    knots, values = toxicity.isotonic(x, y, np.ones(5))
    assert (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1
    assert np.interp(0.2, knots, values) == pytest.approx(0.4)


# quality


def test_quality_on_held_out_rows(data):
    docs, labels, rows, marks = data
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    right = [got[i].predicted == y for i, y, _, _, _ in marks if fold(i)]
    assert sum(right) / len(right) > 0.97
    assert all(got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == fold(i) for i in got)


def test_repeats_are_seen_at_every_distance_and_length(monkeypatch):
    rng = np.random.default_rng(4)
    for gap in range(8):
        once = rng.integers(0, 256, 300, dtype=np.uint8).tobytes()
        rows, _ = quality.encode([once + bytes(range(gap)) + once], quality._byte_classes())
        assert rows[1, -2] > 0.5
    clean = rng.integers(0, 256, 1 << 20, dtype=np.uint8).tobytes()
    assert quality.encode([clean], quality._byte_classes())[0][:, -2].max() == 0
    body = np.frombuffer(clean[:5000] + clean[1000:4000], np.uint8)
    whole = quality.repeats(body)
    monkeypatch.setattr(quality, "SORTED", 700)
    assert (quality.repeats(body) == whole).all() and whole.sum() == 2993


def slow_quality(model, text):
    """The score of one text, passage by passage in plain loops."""
    table, body, p = quality._byte_classes(), text or b"", model.p
    seen, again = set(), []
    for i in range(len(body) - 7):
        again.append(body[i : i + 8] in seen)
        seen.add(body[i : i + 8])
    codes, logits = [], []
    for begin in range(0, max(1, len(body)), quality.PASSAGE):
        x = np.zeros(quality.FEATURES)
        pairs = [(table[body[i]], table[body[i + 1]]) for i in range(begin, min(begin + quality.PASSAGE, len(body) - 1))]
        for one, two in pairs:
            x[one * quality.CLASSES + two] += 1 / len(pairs)
        x = np.sqrt(x)
        own = again[begin : begin + quality.PASSAGE]
        x[-2], x[-1] = sum(own) / max(1, len(own)), float(len(body) > 0)
        code = np.maximum((x - model.mean) * model.scale @ p["w"] + p["b"], 0)
        codes.append(code)
        logits.append(float((np.tanh(code @ p["v"]) / (1 + np.exp(-(code @ p["u"])))) @ p["a"][:, 0]))
    weights = np.exp(np.array(logits) - max(logits))
    pooled = (weights / weights.sum()) @ np.array(codes)
    return 1 / (1 + np.exp(-float(pooled @ p["c"][:, 0] + p["d"][0])))


def test_quality_equals_plain_loops(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.select("doc_id", F.col("text").cast("binary").alias("text")).limit(60).collect():
        assert got[r.doc_id] == pytest.approx(slow_quality(model, None if r.text is None else bytes(r.text)), abs=1e-3)


def test_long_texts_are_pooled_piece_by_piece(spark, frame, data, monkeypatch):
    docs, labels, rows, _ = data
    model, table = quality.fit(docs, labels), quality._byte_classes()
    text = (" ".join(body for _, body, _ in rows)).encode()
    whole = model.score(*quality.encode([text], table))
    monkeypatch.setattr(quality, "PIECE", 7)
    assert np.allclose(model.score_long(text, table), [whole[0][0], whole[1][0]], atol=1e-5)
    rows_, sizes = quality.encode([text, b"short"], table)
    assert sizes.tolist() == [quality.passages(text), 1] and len(rows_) == sizes.sum()


def test_training_rows_are_taken_whole_up_to_a_number_of_passages(frame, spark):
    rows = [(i, "word " * (1000 if i % 2 else 10), "en") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0, None, None) for i in range(40)], LABELS)
    short = quality.fit(frame(rows), labels, most=9)  # no long row fits
    assert not short.fitted and short.share == 0.0
    assert quality.fit(frame(rows), labels).fitted


def test_quality_gradients():
    rng = np.random.default_rng(1)
    rows = rng.random((9, quality.FEATURES)).astype(np.float32)
    model = quality.Model(0.5)
    model._start(rows)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    starts, bags, labels = np.array([0, 4, 5]), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model._forward(rows, starts, bags)["score"]
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    gradients = model._gradients(model._forward(rows, starts, bags), labels, starts, bags)
    for name, at in (("w", (5, 3)), ("b", (2,)), ("v", (1, 2)), ("u", (3, 4)), ("a", (2, 0)), ("c", (4, 0)), ("d", (0,))):
        held = model.p[name][at]
        model.p[name][at] = held + 1e-5
        up = loss()
        model.p[name][at] = held - 1e-5
        down = loss()
        model.p[name][at] = held
        assert gradients[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_passages_cover_the_whole_text():
    table = quality._byte_classes()
    text = ("abc DEF 12|3\n" * 9000).encode()
    rows, sizes = quality.encode([text, b"", None, b"x"], table)
    assert sizes.tolist() == [-(-len(text) // 512), 1, 1, 1] and len(rows) == sizes.sum()
    pairs = rows[: sizes[0], :-2] ** 2
    assert np.allclose(pairs.sum(1), 1, atol=1e-4)
    assert rows[0, -2] > 0.8 and not rows[sizes[0], :].any()


# language


def test_language_on_held_out_rows(data):
    docs, _, rows, _ = data
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if fold(i)]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 and r.held_out == fold(i) for i, r in got.items())


def test_kernel_equals_brute_force():
    table = language.symbol_table()
    texts = ["the house", "das haus", "x", "über the", "haushaus"]
    sets = [language.grams(t, table) for t in texts]
    model = language.Model(sets, ["a", "b", "a", "b", "b"])

    def slow(text):
        codes = [0, *(table[ord(c)] for c in text.lower()), 0]
        return {(n, tuple(codes[i : i + n])) for n in (1, 2, 3) for i in range(len(codes) - n + 1)} - {(1, (0,))}

    turns = [0, 1, 2, 3, 4]
    presence = np.array([[g in s for g in model.vocabulary] for s in map(set, map(np.ndarray.tolist, sets))], np.float32)
    kernel = model._kernel(presence, np.array([len(s) for s in sets]))
    order = sorted(turns, key=lambda i: ({"a": [0, 2], "b": [1, 3, 4]}["ab"[i in (1, 3, 4)]].index(i), i in (1, 3, 4)))
    for i, a in enumerate(texts):
        for j, k in enumerate(order):
            x, y = slow(a), slow(texts[k])
            assert kernel[i, j] == pytest.approx(len(x & y) / (len(x) * len(y)) ** 0.5, abs=1e-5)


def test_odd_inputs(spark, odd, no_docs, data):
    docs, labels, _, _ = data
    models = [(toxicity.score, toxicity.fit(docs, labels)), (quality.score, quality.fit(docs, labels)), (language.predict, language.fit(docs))]
    bare = [(toxicity.score, toxicity.fit(odd, labels.limit(0))), (quality.score, quality.fit(no_docs, labels)), (language.predict, language.fit(no_docs))]
    for apply, model in models + bare:
        got = apply(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert apply(no_docs, model).count() == 0
    und = {r.doc_id for r in language.predict(odd, models[2][1]).collect() if r.lang_pred == "und"}
    assert und == {1, 2, 3, 8}
    assert toxicity.reject(no_docs, models[0][1]).count() == 0


def test_texts_of_the_held_out_fold_are_not_learnt(spark, frame):
    rows = [(i, "secretword common" if fold(i) else "common", "xx" if fold(i) else "en") for i in range(200)]
    labels = spark.createDataFrame([(i, 0, int(fold(i)), None, None) for i in range(200)], LABELS)
    assert "secretword" not in toxicity.fit(frame(rows), labels).terms
    assert language.fit(frame(rows)).langs == ["en"]
