"""The overlay algebra and log folds against plain dictionaries."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pytest

from keelstate.operators import overlay as algebra
from keelstate.operators import replay
from keelstate.operators.overlay import Overlay

BASE = {"a": "alpha", "b": "beta", "c": "gamma"}


def rows(spark, found):
    return spark.createDataFrame(sorted(found.items()), "k string, v string")


def keyed(spark, found):
    return spark.createDataFrame([(k,) for k in found], "k string")


def made(spark, puts, deletes):
    return Overlay(rows(spark, puts), keyed(spark, deletes), ["k"])


def as_dict(frame):
    found = [(r.k, r.v) for r in frame.collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


def test_merged_view(spark):
    delta = made(spark, {"a": "ALPHA", "d": "delta"}, ["c"])
    base = rows(spark, BASE)
    assert as_dict(algebra.apply(base, delta)) == {"a": "ALPHA", "b": "beta", "d": "delta"}
    placed = algebra.iterate(base, delta).orderBy("src", "k").collect()
    assert [(r.src, r.k) for r in placed] == [(0, "b"), (1, "a"), (1, "d")]
    found = {r.k: (r.present, r.v) for r in algebra.lookup(keyed(spark, "abcdx"), base, delta, ["v"]).collect()}
    assert found == {"a": (True, "ALPHA"), "b": (True, "beta"), "c": (False, None), "d": (True, "delta"), "x": (False, None)}


def test_retain(spark):
    kept, removed = algebra.retain(rows(spark, BASE), made(spark, {"d": "delta"}, []), F.col("v").rlike("^[ad]"))
    assert as_dict(kept) == {"a": "alpha", "d": "delta"}
    assert {r.k for r in removed.collect()} == {"b", "c"}


def test_retain_of_a_shadowing_put(spark):
    kept, removed = algebra.retain(rows(spark, BASE), made(spark, {"a": "ALPHA_UPDATED"}, []), F.col("v").startswith("b"))
    assert as_dict(kept) == {"b": "beta"}
    assert {r.k for r in removed.collect()} == {"a", "c"}


def test_delete_then_put_and_back(spark):
    base = rows(spark, BASE)
    delta = algebra.delete(made(spark, {}, []), base, keyed(spark, ["a", "nope"]))
    assert {r.k for r in delta.deletes.collect()} == {"a"}
    delta = algebra.put(delta, rows(spark, {"a": "resurrected"}))
    assert as_dict(algebra.apply(base, delta))["a"] == "resurrected"
    delta = algebra.delete(delta, base, keyed(spark, ["a"]))
    assert delta.puts.isEmpty() and "a" not in as_dict(algebra.apply(base, delta))
    assert made(spark, {}, []).is_empty() and not delta.is_empty()


def test_existed(spark):
    delta = made(spark, {"d": "delta"}, ["c"])
    found = {r.k: r.existed for r in algebra.existed(keyed(spark, "acdx"), rows(spark, BASE), delta).collect()}
    assert found == {"a": True, "c": True, "d": True, "x": False}


OPS = st.lists(st.tuples(st.sampled_from("abcdef"), st.one_of(st.none(), st.integers(0, 9))), max_size=25)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS)
def test_folds_equal_a_dictionary(spark, ops):
    want = {}
    for key, value in ops:
        want.pop(key, None) if value is None else want.__setitem__(key, value)
    log = spark.createDataFrame(
        [(i, k, "delete" if v is None else "put", v) for i, (k, v) in enumerate(ops)], "seq long, k string, kind string, v int"
    )
    newest = [F.col("seq").desc()]
    assert as_dict(replay.live(log, ["k"], newest)) == want
    assert as_dict(replay.live(log.union(log), ["k"], newest)) == want
    assert as_dict(replay.folded(log, ["k"], ["seq"])) == want
    half = replay.live(replay.prefix(log, "seq", 11), ["k"], newest).select("k", "v")
    assert as_dict(replay.onto(half, log.filter("seq > 11"), ["k"], newest)) == want


def test_bad_text_keys(spark):
    for kind in ("put", "delete"):
        log = spark.createDataFrame([(1, bytearray(b"\xff\xfe"), kind)], "seq long, k binary, kind string")
        with pytest.raises(Exception, match="invalid UTF-8"):
            replay.converted(log, "k", replay.checked_text).collect()


def test_rollback_drops_whole_transactions(spark):
    log = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "c", False)], "tx long, k string, bad boolean")
    assert [r.k for r in replay.committed_only(log, "tx", F.col("bad")).collect()] == ["c"]
