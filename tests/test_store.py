"""Transactions, durability, recovery and concurrency."""

import asyncio
import json
import threading
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelstate.async_store import AsyncStore
from keelstate.errors import Invalid, IoError, LogCorrupted, NotFound, SnapshotVersion
from keelstate.schema import state
from keelstate.store import FlushPolicy, Store

ITEMS = state(items=(0, "k string", "v string"))
APP = state(users=(0, "k string", "name string, email string"), counters=(1, "k string", "v long", False))


def content(store, name="items"):
    return {r[0]: r[1] for r in store.read()[name].collect()}


def put(key, value="v"):
    return lambda tx: tx.items.put(key, value)


# in memory


def test_write_read_rollback(spark):
    store = Store.memory(spark, APP)

    def first(tx):
        tx.users.put("alice", {"name": "Alice", "email": "a@x"})
        tx.counters.put("n", 1)
        assert "alice" in tx.users and tx.users.get("alice") == ("Alice", "a@x")
        return 7

    assert store.write(first) == 7

    def failing(tx):
        tx.users.put("bob", ("Bob", "b@x"))
        assert tx.users.delete("alice")
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.write(failing)
    state_ = store.read()
    assert state_.has("users", "alice") and not state_.has("users", "bob")
    assert state_.get("counters", "n") == 1 and state_.get("counters", "x") is None
    assert state_.at("users", "alice") == ("Alice", "a@x") and state_.count("users") == 1
    with pytest.raises(NotFound):
        state_.at("users", "bob")


def test_versions_are_immutable(spark):
    store = Store.memory(spark, ITEMS)
    store.write(put("a", "1"))
    before = store.read()
    store.write(put("a", "2"))
    assert before.get("items", "a") == "1" and store.read().get("items", "a") == "2"
    assert {r.k: r.v for r in before["items"].collect()} == {"a": "1"}


def test_delete_update_and_views(spark):
    store = Store.memory(spark, ITEMS)

    def body(tx):
        for key, value in (("b", "beta"), ("a", "alpha"), ("c", "gamma")):
            tx.items.put(key, value)
        assert not tx.items.delete("nope") and tx.items.delete("c") and not tx.items.delete("c")
        assert tx.items.update("a", str.upper) and not tx.items.update("z", str.upper)

    store.write(body)
    assert [tuple(r) for r in store.read().iterate("items").collect()] == [("a", "ALPHA"), ("b", "beta")]

    def seen(tx):
        tx.items.put("a", "new")
        tx.items.put("d", "delta")
        assert [(r.src, r.k) for r in tx.items.iterate().collect()] == [(0, "b"), (1, "a"), (1, "d")]
        assert {r.v for r in tx.items.values().collect()} == {"beta", "new", "delta"}
        assert not tx.items.is_empty()

    store.write(seen)
    present = store.read().contains("items", spark.createDataFrame([("a",), ("x",)], "k string"))
    assert {r.k: r.present for r in present.collect()} == {"a": True, "x": False}
    store.read().register_views()
    assert spark.sql("select count(*) from items").first()[0] == 3


def test_bulk_and_single_operations_mix(spark):
    store = Store.memory(spark, ITEMS)
    store.write(put("a", "old"))
    many = spark.range(5).select(F.concat(F.lit("n"), F.col("id")).alias("k"), F.col("id").cast("string").alias("v"))

    def body(tx):
        tx.items.put("n1", "single")
        tx.items.put_df(many)
        assert tx.items.get("n1") == "1"
        tx.items.put("n2", "later")
        existed = tx.items.delete_df(spark.createDataFrame([("n3",), ("zz",)], "k string"))
        assert {r.k: r.existed for r in existed.collect()} == {"n3": True, "zz": False}
        removed = tx.items.retain(F.col("v") != "4")
        assert [r.k for r in removed.collect()] == ["n4"]

    store.write(body)
    assert content(store) == {"a": "old", "n0": "0", "n1": "1", "n2": "later"}


def test_bad_bulk_keys(spark):
    store = Store.memory(spark, ITEMS)
    twice = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "k string, v string, n int")
    with pytest.raises(Invalid, match="repeat"):
        store.write(lambda tx: tx.items.put_df(twice))
    with pytest.raises(Invalid, match="null"):
        store.write(lambda tx: tx.items.put_df(spark.createDataFrame([(None, "1")], "k string, v string")))
    store.write(lambda tx: tx.items.put_df(twice, order_by="n"))
    assert content(store) == {"a": "2"}


def test_nested_and_late_writes(spark):
    store = Store.memory(spark, ITEMS)
    with pytest.raises(Invalid, match="inside"):
        store.write(lambda tx: store.write(put("a")))
    kept = []
    store.write(kept.append)
    with pytest.raises(Invalid, match="ended"):
        kept[0].items.put("a", "b")
    store.close()
    with pytest.raises(Invalid, match="closed"):
        store.write(put("a"))


def test_derived_views(spark):
    schema = state({"by_value": lambda s: s["items"].groupBy("v").agg(F.array_sort(F.collect_list("k")).alias("ks"))}, items=(0, "k string", "v string"))
    store = Store.memory(spark, schema)
    store.write(lambda tx: [tx.items.put(k, v) for k, v in (("a", "x"), ("b", "x"), ("c", "y"))])
    assert {r.v: r.ks for r in store.read()["by_value"].collect()} == {"x": ["a", "b"], "y": ["c"]}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcde"), st.one_of(st.none(), st.text("xyz", max_size=2))), max_size=6), max_size=5), st.booleans())
def test_store_equals_a_dictionary(spark, tmp_path_factory, transactions, compact):
    path = str(tmp_path_factory.mktemp("store"))
    store, want = Store.open(spark, ITEMS, path), {}
    for number, ops in enumerate(transactions):

        def body(tx, ops=ops):
            for key, value in ops:
                tx.items.delete(key) if value is None else tx.items.put(key, value)

        store.write(body)
        for key, value in ops:
            want.pop(key, None) if value is None else want.__setitem__(key, value)
        if compact and number == 2:
            store.compact()
    assert content(store) == want
    store.close()
    assert content(Store.open(spark, ITEMS, path)) == want


# on disk


def test_reopen_and_several_collections(spark, tmp_path):
    path = str(tmp_path / "deep" / "er")
    with Store.open(spark, APP, path) as store:
        store.write(lambda tx: (tx.users.put("a", ("A", "a@x")), tx.counters.put("n", 5)))
        store.write(lambda tx: tx.counters.delete("n"))
    store = Store.open(spark, APP, path)
    assert store.read().get("users", "a") == ("A", "a@x") and not store.read().has("counters", "n")
    assert store.read().seq == 2


def test_snapshot_and_log(spark, tmp_path):
    path = str(tmp_path)
    store = Store.open(spark, ITEMS, path)
    store.write(lambda tx: [tx.items.put(k, "old") for k in "ab"])
    store.compact()
    store.write(put("a", "new"))
    assert content(store) == {"a": "new", "b": "old"}
    again = Store.open(spark, ITEMS, path)
    assert content(again) == {"a": "new", "b": "old"} and again.log.count == 1


def test_threshold_survives_reopening(spark, tmp_path):
    path = str(tmp_path)
    store = Store.open(spark, ITEMS, path, snapshot_threshold=3)
    store.write(put("a"))
    store.write(put("b"))
    assert store.log.snapshot is None
    store = Store.open(spark, ITEMS, path, snapshot_threshold=3)
    store.write(put("c"))
    assert store.log.snapshot["seq"] == 3 and store.log.count == 0 and set(content(store)) == set("abc")


def test_a_version_outlives_a_compaction(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    store.write(put("a", "1"))
    store.compact()
    held = store.read()
    store.write(put("a", "2"))
    store.compact()
    assert {r.k: r.v for r in held["items"].collect()} == {"a": "1"}


def test_bulk_commits(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    many = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("v").alias("v"))
    store.write(lambda tx: tx.items.put_df(many))
    store.write(put("5", "changed"))
    store.write(lambda tx: tx.items.delete_df(many.filter("k >= '6'").select("k")))
    again = Store.open(spark, ITEMS, str(tmp_path))
    want = {str(i): "v" for i in range(1000) if str(i) < "6"} | {"5": "changed"}
    assert content(store) == want == content(again)


def damaged(path, how, number=2):
    log = Path(path)
    if how == "manifest":
        (log / "commits" / f"{number:020d}.json").write_bytes(b"{")
    elif how == "missing":
        (log / "commits" / f"{number:020d}.json").unlink()
    else:
        part = next((log / "log" / f"{number:020d}").rglob("*.parquet"))
        data = part.read_bytes()
        part.write_bytes(data[:-2] if how == "cut" else data[:-2] + bytes(b ^ 0xFF for b in data[-2:]))


@pytest.mark.parametrize("how", ["manifest", "missing", "cut", "flipped"])
def test_recovery_keeps_the_valid_prefix_and_appends_stay(spark, tmp_path, how):
    path = str(tmp_path)
    store = Store.open(spark, ITEMS, path)
    for key in "abc":
        store.write(put(key))
    damaged(path, how)
    store = Store.open(spark, ITEMS, path)
    assert set(content(store)) == {"a"}
    store.write(put("d"))
    assert set(content(Store.open(spark, ITEMS, path))) == {"a", "d"}


def test_versions_and_schemas_are_checked(spark, tmp_path):
    path = str(tmp_path)
    store = Store.open(spark, ITEMS, path)
    store.write(put("a"))
    with pytest.raises(Invalid, match="other collections"):
        Store.open(spark, APP, path)
    store.compact()
    with pytest.raises(Invalid, match="other collections"):
        Store.open(spark, APP, path)
    mark = next(tmp_path.glob("snapshots/*.json"))
    mark.write_text(json.dumps(json.loads(mark.read_text()) | {"format_version": 99}))
    with pytest.raises(SnapshotVersion, match="got 99"):
        Store.open(spark, ITEMS, path)
    other = tmp_path / "other"
    Store.open(spark, ITEMS, str(other)).write(put("a"))
    mark = next(other.glob("commits/*.json"))
    mark.write_text(json.dumps(json.loads(mark.read_text()) | {"format_version": 99}))
    with pytest.raises(LogCorrupted, match="unsupported version"):
        Store.open(spark, ITEMS, str(other))


def test_values_that_do_not_fit(spark, tmp_path):
    store = Store.open(spark, APP, str(tmp_path))
    with pytest.raises(Invalid):
        store.write(lambda tx: tx.counters.put("n", "text"))
    assert not store.read().has("counters", "n")
    store.write(lambda tx: tx.counters.put("n", 1))
    assert Store.open(spark, APP, str(tmp_path)).read().get("counters", "n") == 1


# grouped durability


def test_grouped_writes_are_seen_then_durable(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    store.set_flush_policy(FlushPolicy.grouped(60))
    store.write(put("a"))
    store.write(put("b"))
    assert set(content(store)) == {"a", "b"}
    assert not list(tmp_path.glob("commits/*.json"))
    store.flush()
    assert len(list(tmp_path.glob("commits/*.json"))) == 1
    store.write(put("c"))
    store.write_durable(put("d"))
    assert set(content(Store.open(spark, ITEMS, str(tmp_path)))) == set("abcd")
    store.write(put("e"))
    store.close()
    assert set(content(Store.open(spark, ITEMS, str(tmp_path)))) == set("abcde")


def test_grouped_bulk(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    store.set_flush_policy(FlushPolicy.grouped(60))
    store.write(lambda tx: tx.items.put_df(spark.createDataFrame([("x", "1")], "k string, v string")))
    store.write(put("y", "2"))
    assert content(store) == {"x": "1", "y": "2"} and store.read().collections["items"].loose
    store.flush()
    assert content(store) == {"x": "1", "y": "2"} and not store.read().collections["items"].loose
    store.write(lambda tx: tx.items.delete_df(spark.createDataFrame([("x",)], "k string")))
    store.write_durable(put("z", "3"))
    assert content(store) == {"y": "2", "z": "3"} and not store.read().collections["items"].loose
    store.close()
    assert content(Store.open(spark, ITEMS, str(tmp_path))) == {"y": "2", "z": "3"}


def test_a_table_is_made_once(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    made = spark.range(20).select(F.col("id").cast("string").alias("k"), F.uuid().alias("v"))

    def body(tx):
        tx.items.put_df(made)
        return {r.k: r.v for r in tx.items.df().collect()}

    seen = store.write(body)
    assert seen == content(store) == content(Store.open(spark, ITEMS, str(tmp_path)))


def test_a_failed_flush_is_told_once_and_loses_nothing(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    store.set_flush_policy(FlushPolicy.grouped(60))
    real, fails = store.log.sync, [True]

    def sync():
        if fails.pop() if fails else False:
            raise OSError("injected")
        real()

    store.log.sync = sync
    store.write(put("a"))
    with pytest.raises(IoError, match="injected"):
        store.flush()
    assert store.flush_error() is None
    store.write(put("b"))
    store.flush()
    store.close()
    assert set(content(Store.open(spark, ITEMS, str(tmp_path)))) == {"a", "b"}


def test_a_stored_error_fails_the_next_write(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    store.set_flush_policy(FlushPolicy.grouped(60))
    store._error = IoError("earlier")
    with pytest.raises(IoError, match="earlier"):
        store.write(put("a"))
    store.write(put("a"))
    store.close()


class CountingBackend:
    def __init__(self):
        self.saves, self.fail_next, self.rows = 0, False, {}

    def load(self, spark, schema):
        return {}

    def save(self, state_):
        if self.fail_next:
            self.fail_next = False
            raise IoError("injected")
        self.saves += 1
        self.rows = {name: state_[name].count() for name in state_}


def test_backends(spark):
    backend = CountingBackend()
    store = Store.with_backend(spark, ITEMS, backend)
    store.write(put("a"))
    assert backend.saves == 1 and backend.rows == {"items": 1} and store.backend is backend
    backend.fail_next = True
    with pytest.raises(IoError):
        store.write(put("b"))
    assert set(content(store)) == {"a"}  # a failed save changes nothing
    store.set_flush_policy(FlushPolicy.grouped(60))
    for key in "cde":
        store.write(put(key))
    assert backend.saves == 1
    store.flush()
    assert backend.saves == 2 and backend.rows == {"items": 4}
    store.close()


# many at once


def test_concurrent_writers(spark):
    store = Store.memory(spark, ITEMS)

    def work(n):
        for i in range(50):
            store.write(put(f"{n}-{i}"))

    threads = [threading.Thread(target=work, args=(n,)) for n in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.read().count("items") == 1000


def test_concurrent_grouped_writers_and_compaction(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path), snapshot_threshold=60)
    store.set_flush_policy(FlushPolicy.grouped(0.02))

    def work(n):
        for i in range(15):
            (store.write_durable if n == 0 else store.write)(put(f"{n}-{i}"))

    threads = [threading.Thread(target=work, args=(n,)) for n in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store.flush(60)
    store.close()
    assert Store.open(spark, ITEMS, str(tmp_path)).read().count("items") == 75


def test_async_store(spark, tmp_path):
    async def main():
        store = await AsyncStore.open(spark, ITEMS, str(tmp_path))
        other = store.clone()

        async def work(n):
            for i in range(10):
                await other.write(put(f"{n}-{i}"))

        await asyncio.gather(*(work(n) for n in range(10)))
        await store.write_durable(put("last"))
        await store.flush()
        assert store.read().count("items") == 101
        with pytest.raises(ValueError):
            await store.write(lambda tx: int("x"))
        await store.close()

    asyncio.run(main())


def test_a_flipped_byte_of_bulk_data_ends_the_valid_run(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    store.write(put("a"))
    for number, rows in ((2, 300_000), (3, 5)):  # one table written by Spark, one by the driver
        store.write(lambda tx: tx.items.put_df(spark.range(rows).select(F.concat(F.lit(f"{number}-"), F.col("id")).alias("k"), F.lit("v").alias("v"))))
    commits = [json.loads(p.read_text()) for p in sorted(tmp_path.glob("commits/*.json"))]
    assert [c["parts"][0].get("bulk") for c in commits] == [None, True, True] and all(c["parts"][0]["crc32"] for c in commits)
    damaged(tmp_path, "flipped", 3)
    store = Store.open(spark, ITEMS, str(tmp_path))
    assert store.read().count("items") == 300_001 and "checksum" in store.log.recovered
    damaged(tmp_path, "flipped", 2)
    store = Store.open(spark, ITEMS, str(tmp_path))
    assert set(content(store)) == {"a"} and "checksum" in store.log.recovered
    store.write(put("b"))
    assert set(content(Store.open(spark, ITEMS, str(tmp_path)))) == {"a", "b"}


def test_an_unreadable_snapshot_is_an_error_and_nothing_is_set_aside(spark, tmp_path):
    store = Store.open(spark, ITEMS, str(tmp_path))
    for key in "ab":
        store.write(put(key))
        store.compact()
    store.write(put("c"))
    marks = sorted(tmp_path.glob("snapshots/*.json"))
    kept = [m.read_bytes() for m in marks]
    marks[-1].write_bytes(b"{")
    assert set(content(Store.open(spark, ITEMS, str(tmp_path)))) == set("abc")  # the older one and its commits reach as far
    marks[-1].write_bytes(kept[-1])
    part = next((tmp_path / "snapshots" / marks[-1].stem).rglob("*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-2] + bytes(b ^ 0xFF for b in whole[-2:]))
    assert set(content(Store.open(spark, ITEMS, str(tmp_path)))) == set("abc")
    for mark in marks:
        mark.write_bytes(b"{")
    with pytest.raises(LogCorrupted, match="unreadable snapshot"):
        Store.open(spark, ITEMS, str(tmp_path))
    assert not list(tmp_path.glob("quarantine/*"))
    marks[0].write_bytes(kept[0])
    assert set(content(Store.open(spark, ITEMS, str(tmp_path)))) == set("abc")


def test_no_write_is_lost_beside_a_close(spark, tmp_path):
    for trial in range(3):
        path, done = str(tmp_path / str(trial)), []
        store = Store.open(spark, ITEMS, path)
        store.set_flush_policy(FlushPolicy.grouped(5.0))

        def work():
            try:
                for i in range(10**6):
                    store.write(put(f"{i}"))
                    done.append(i)
            except Invalid:
                pass

        thread = threading.Thread(target=work)
        thread.start()
        while len(done) < 300:
            pass
        (store.close if trial else lambda: (store.set_flush_policy(FlushPolicy.immediate()), store.close()))()
        thread.join()
        assert Store.open(spark, ITEMS, path).read().count("items") == len(done)


def test_the_driver_holds_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("keelstate.store.HELD_ROWS", 10)
    for store in (Store.memory(spark, ITEMS), Store.open(spark, ITEMS, str(tmp_path))):

        def body(tx):
            for i in range(35):
                tx.items.put(f"k{i % 30}", str(i))
                if i % 7 == 0:
                    assert tx.items.delete(f"k{i % 30}") and f"k{i % 30}" not in tx.items
                assert len(tx.items.changes) <= 10
            assert tx.items.get("k3") == "33"

        store.write(body)
        want = {}
        for i in range(35):
            want[f"k{i % 30}"] = str(i)
            if i % 7 == 0:
                del want[f"k{i % 30}"]
        assert content(store) == want
    assert content(Store.open(spark, ITEMS, str(tmp_path))) == want
    store.set_flush_policy(FlushPolicy.grouped(60))
    for i in range(25):
        store.write(put(f"n{i}"))
    assert len(list(tmp_path.glob("commits/*.json"))) >= 3 and store.read().count("items") == len(want) + 25
    store.close()


def test_large_tables_are_checked_in_the_job_that_stores_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("keelstate.store.HELD_BYTES", 0)
    store = Store.open(spark, ITEMS, str(tmp_path))
    for rows, message in (([("a", "1"), ("a", "2")], "repeat"), ([(None, "1"), ("b", "2")], "null")):
        with pytest.raises(Invalid, match=message):
            store.write(lambda tx: tx.items.put_df(spark.createDataFrame(rows, "k string, v string")))
    assert content(store) == {}
    store.write(lambda tx: tx.items.put_df(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")))
    store.write(lambda tx: tx.items.put_df(spark.createDataFrame([], "k string, v string")))
    assert content(Store.open(spark, ITEMS, str(tmp_path))) == {"a": "1", "b": "2"}
