import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
from pyspark.sql import functions as F

from keelstate.llm import topk as op

SCHEMA = "vec_id long, embedding array<double>, label int, query_id long, score long"


def brute(rows, k=10, step=100):
    fine = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in sorted({i: min(v for j, v in fine if j == i) for i, _ in fine}.items()):
        if q % step == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)]) for i in range(320)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one vector many times
    rows += [(500, None), (600, []), (700, [None] * 16), (800, [math.nan] * 16), (900, [math.inf] * 16), (None, rows[0][1])]
    rows += [(1100 + i, [0.5, -0.25]) for i in range(4)] + [rows[7], rows[7], (0, rows[0][1]), (1200, [0.0] * 16)]
    frame = table(spark, rows).repartition(3)
    for size in (op.QUERY_BLOCK, 2):
        got = op.search(frame, F.col("vec_id") % 100 == 0, query_block=size).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_empty_and_single(spark):
    frame = table(spark, [(0, [1.0, 2.0])])
    assert op.search(frame, F.col("vec_id") % 100 == 0).count() == 0
    assert op.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_wide_components_are_multiplied_exactly(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 0, 0, 5, 6]) for _ in range(3)]) for i in range(260)]
    rows += [(300, [3e6, -3e6, 1.0]), (400, [1.0, 1.0, 1.0])]
    for size in (op.BLOCK_BYTES, 100):
        got = op.search(table(spark, rows).repartition(2), F.col("vec_id") % 100 == 0, block_bytes=size).collect()
        assert sorted(map(tuple, got)) == brute(rows)
    got = op.search(table(spark, [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [1.0, 1.0])]), F.col("vec_id") % 100 == 0).collect()
    assert [(r.vec_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(1, 12), st.integers(0, 10**6))
def test_block_equals_sort(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-9, 10, (n, dim))
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    query = rng.integers(-9, 10, dim)
    got_ids, scores = op.Block(ids, vectors).top(int(ids[0]), query, k)
    order = np.lexsort((ids, -(vectors @ query)))
    order = order[ids[order] != ids[0]][:k]
    assert sorted(zip((-scores).tolist(), got_ids.tolist())) == list(zip((-(vectors @ query))[order].tolist(), ids[order].tolist()))
