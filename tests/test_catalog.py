"""Every catalogued query against its oracle text, and the entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from keelstate.plans import catalog, store_catalog
from keelstate.store import _equals

QUERIES, ORACLES = catalog.QUERIES | store_catalog.QUERIES, catalog.ORACLES | store_catalog.ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, oracle, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    found = oracle.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert got == want


def test_entry_points(spark):
    assert driver.entry(spark).count() > 0
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_point_reads_reach_the_scan(spark, sf_dir):
    held = catalog.version(spark, sf_dir).collections["customer"]
    plan = held.base.filter(_equals(held.spec, (42,)))._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,42)" in plan


def test_pruned_columns(spark, sf_dir):
    plan = catalog.read_value_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "c_name" not in plan.split("Physical Plan")[1]


def test_positions_past_the_sample_of_ranges(spark):
    """Ranges are cut from a sample; rows and the counts of their ranges must agree all the same."""
    small = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rows = spark.range(20000).selectExpr("id * 7919 % 20011 as k", "id as v")
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        found = {r.k: (r.pos, r.v) for r in catalog.numbered(rows, ["k"], "pos").collect()}
    finally:
        for name in small:
            spark.conf.unset(name)
    want = sorted((i * 7919 % 20011, i) for i in range(20000))
    assert found == {k: (pos, i) for pos, (k, i) in enumerate(want, 1)}


def test_keys_put_twice_are_placed_in_the_order_of_puts(spark, tmp_path):
    rows = spark.range(0, 100050, 10, 1).selectExpr("id as c_custkey", "-id / 2 as c_acctbal")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    last = sorted(catalog.overlay_iter(spark, str(tmp_path)).filter("c_custkey >= 100000").collect(), key=lambda r: r.pos)
    want = [(1, k, value) for k in range(100000, 100050, 10) for value in (100 - k / 2, 1.0)]
    assert [(r.src, r.c_custkey, r.c_acctbal) for r in last] == want
    assert [r.pos for r in last] == list(range(10001, 10011))


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Customers past key 100,000, some of which the delta of the overlay queries puts twice, or deletes and puts."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    rows = spark.range(60).union(spark.range(99990, 100060)).union(spark.range(33330, 33350))
    rows.selectExpr("id as c_custkey", "double(id - 100020.5) as c_acctbal").write.parquet(f"{folder}/customer.parquet")
    return folder


def both(spark, folder, name):
    """Rows of a query over customers alone, and of its SQL."""
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{folder}/customer.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, folder).select(*columns)
    return sorted(map(tuple, found.collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_commit_of_keys_put_twice(spark, crowded):
    got, want = both(spark, crowded, "commit_delta")
    assert got == want
    assert len(want) == len({k for k, _ in want}) + 5


def test_presence_of_keys_deleted_and_put(spark, crowded):
    got, want = both(spark, crowded, "overlay_contains")
    assert got == want
    assert {(100011, False), (100014, True), (100020, True)} <= set(want)


def test_values_of_keys_deleted_and_put(spark, crowded):
    got, want = both(spark, crowded, "overlay_get")
    assert got == want
    assert (100011, None) in want and [v for k, v in want if k == 100020] == [1.0, 99.5]
