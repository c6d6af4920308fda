import random

import numpy as np
import pytest
import xxhash

from keelstate.llm import simhash as op
from keelstate.llm.components import components
from tests.llm.conftest import ODD


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(docs):
    prints = [slow_fingerprint(text) for _, text in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)), key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 40, 300]))
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            docs.append("  ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    docs += docs[:5]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_fingerprints_equal_slow_ones():
    for _, text in corpus() + [(0, t) for _, t in ODD]:
        assert op.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_clusters_equal_brute_force(spark, frame):
    docs = corpus()
    got = op.clusters(frame(docs)).collect()
    want = slow_components(docs)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert len({c for _, _, c in want}) < len(docs) - 20
    kept = op.keep_one(frame(docs))
    assert kept.columns == frame(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_odd_inputs(frame, odd, no_docs):
    assert sorted((tuple(r) for r in op.clusters(odd).collect()), key=repr) == slow_components(ODD)
    assert op.clusters(no_docs).count() == 0 and op.keep_one(no_docs).count() == 0
    kept = [r.doc_id for r in op.keep_one(odd).collect()]
    assert kept.count(5) == 1 and kept.count(None) == 1 and 2 not in kept and 3 not in kept


@pytest.mark.parametrize("leaf, most, sample", [(8, 1 << 14, 4096), (8, 24, 64), (1 << 10, 16, 64), (4, 1 << 14, 3)])
def test_links_keep_every_component(spark, leaf, most, sample):
    rng = np.random.default_rng(leaf + most)
    points = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    near = [p ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for p in points[:40] for a, b in rng.integers(0, 64, (3, 2))]
    chain = [np.uint64((1 << (2 * i)) - 1) for i in range(25)]  # a long chain of links, far from end to end
    points = np.unique(np.concatenate([points, near, chain]))
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = components(op.links(table, leaf, most, sample))
    root = {r.node: r.root for r in found.collect()}
    i, j = op._near(points, points, True)
    want = op.roots(len(points), i, j)
    signed = points.view(np.int64).tolist()
    groups, slow = {}, {}
    for k, p in enumerate(signed):
        groups.setdefault(root.get(p, p), set()).add(p)
        slow.setdefault(int(want[k]), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_components_of_chains_loops_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (201, 202)]
    random.Random(1).shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_points_are_linked_as_by_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    flips = np.uint64(1) << rng.integers(0, 64, (3000, 6)).astype(np.uint64)
    ball = np.unique(np.bitwise_xor.reduce(flips, axis=1))  # within six bits of one point: no vantage parts it
    far = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    points = np.unique(np.concatenate([ball, far]))
    want = op.roots(len(points), *op._near(points, points, True))
    monkeypatch.setattr(op, "RINGS", 64)
    for limit in (op.SORTED, 5000):
        monkeypatch.setattr(op, "SORTED", limit)
        for found in (op.crowded(points), [np.searchsorted(points, x) for x in op.forest(points)]):
            assert (op.roots(len(points), *map(np.asarray, found)) == want).all()
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    shared = op._shared(table).toArrow()
    ends = [np.searchsorted(points, shared.column(c).to_numpy().view(np.uint64)) for c in "ab"]
    assert (op.roots(len(points), *ends) == want).all()


def test_one_row_of_each_component_stays(spark, frame):
    rng = random.Random(12)
    texts = [t for _, t in corpus()][:60] + ["", None]
    for _ in range(3):  # ids that are null or repeat, with equal and with other texts
        docs = [(rng.choice([None, *range(25)]), rng.choice(texts)) for _ in range(90)]
        rows = frame(docs)
        kept = op.keep_one(rows)
        assert kept.columns == rows.columns
        group = {(i, t): n for (i, t), n in zip(docs, slow_roots(docs))}
        stay = [group[r.doc_id, r.text] for r in kept.collect()]
        assert sorted(stay) == sorted(set(group.values()))


def slow_roots(docs):
    numbered = slow_components([(n, text) for n, (_, text) in enumerate(docs)])
    return [root for n, _, root in sorted(numbered)]


def test_only_bounded_things_reach_the_driver(spark, frame):
    plan = op.fingerprints(frame(ODD))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
