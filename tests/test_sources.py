"""Binary logs and streams."""

import pytest
from xxhash import xxh3_64_intdigest

from keelstate.errors import IoError, LogCorrupted
from keelstate.operators import replay
from keelstate.schema import state
from keelstate.sources import binary_log
from keelstate.sources.files import HadoopFiles, LocalFiles
from keelstate.store import Store
from keelstate.streaming.ingest import ingest, ingested, latest_state
from pyspark.sql import functions as F

HEAD = b"EWAL" + bytes([3]) + bytes(11)


def counted(data):
    return bytes([len(data)]) + data


def entry(*ops):
    body = bytes([len(ops)])
    for collection, key, value in ops:
        body += bytes([0 if value is not None else 1, collection]) + counted(key) + (counted(value) if value is not None else b"")
    return len(body).to_bytes(4, "little") + body + xxh3_64_intdigest(body).to_bytes(8, "little")


FIRST, SECOND = entry((0, b"a", b"1"), (1, b"b", b"2")), entry((0, b"a", None))


def test_entries():
    found, end = binary_log.entries(HEAD + FIRST + SECOND)
    assert found == [[("put", 0, b"a", b"1"), ("put", 1, b"b", b"2")], [("delete", 0, b"a", None)]]
    assert end == len(HEAD + FIRST + SECOND)


@pytest.mark.parametrize("tail", [b"\x01\x02", (100).to_bytes(4, "little") + b"abc", SECOND[:-2] + b"xx", SECOND[:6]])
def test_a_bad_tail_is_left_out(tail):
    found, end = binary_log.entries(HEAD + FIRST + tail)
    assert len(found) == 1 and end == len(HEAD + FIRST)


def test_a_hash_over_an_undecodable_payload():
    body = b"\x05\x07"
    bad = len(body).to_bytes(4, "little") + body + xxh3_64_intdigest(body).to_bytes(8, "little")
    assert binary_log.entries(HEAD + bad) == ([], 16)


@pytest.mark.parametrize("data, text", [(b"EWAL", "too short"), (b"BAAD" + bytes(12), "bad magic"), (b"EWAL\x63" + bytes(11), "unsupported version")])
def test_headers(data, text):
    with pytest.raises(LogCorrupted, match=text):
        binary_log.entries(data)


def test_binary_log_as_a_table(spark, tmp_path):
    (tmp_path / "wal.bin").write_bytes(HEAD + FIRST + SECOND)
    log = binary_log.read(spark.read.format("binaryFile").load(str(tmp_path)))
    left = replay.live(log, ["collection", "key"], [F.col("commit_seq").desc(), F.col("op_idx").desc()])
    assert [(r.collection, bytes(r.key)) for r in left.collect()] == [(1, b"b")]


LOG = "seq long, k string, kind string, v string"
OPS = [(1, "a", "put", "1"), (2, "b", "put", "2"), (3, "a", "delete", None), (4, "b", "put", "3"), (5, "c", "put", "4")]


def streamed(spark, path):
    for i, op in enumerate(OPS):
        spark.createDataFrame([op], LOG).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(path)


def test_streamed_fold(spark, tmp_path):
    stream = streamed(spark, str(tmp_path / "in"))
    query = latest_state(stream, ["k"], ["seq"]).writeStream.outputMode("complete").format("memory").queryName("folded").start()
    query.processAllAvailable()
    query.stop()
    assert {r.k: r.v for r in spark.table("folded").collect()} == {"b": "3", "c": "4"}


def test_streamed_ingest_into_a_store(spark, tmp_path):
    schema = state(items=(0, "k string", "v string"))
    store = Store.open(spark, schema, str(tmp_path / "store"))
    stream = streamed(spark, str(tmp_path / "in"))
    query = ingest(stream, store, "items", ["seq"], str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination()
    again = Store.open(spark, schema, str(tmp_path / "store"))
    assert {r.k: r.v for r in again.read()["items"].collect()} == {"b": "3", "c": "4"}
    assert ingested(again, "items") >= 1


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_files(spark, tmp_path, kind):
    files = LocalFiles(f"file://{tmp_path}/x") if kind == "local" else HadoopFiles(spark, f"file://{tmp_path}/x")
    files.publish("a/one.json", b"1")
    with pytest.raises(IoError):
        files.publish("a/one.json", b"2")
    assert files.read("a/one.json") == b"1" and files.names("a") == ["one.json"] and files.names("b") == []
    with pytest.raises(IoError):
        files.read("a/two.json")
    spark.range(3).write.parquet(files.uri("data"))
    assert files.sizes("data") and all(n.endswith(".parquet") for n in files.sizes("data")) and files.sizes("none") == {}
    files.move("a/one.json", "q/one.json")
    assert files.names("a") == [] and files.names("q") == ["one.json"]
    files.remove("q")
    assert files.names("q") == []


def test_a_store_on_a_hadoop_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("keelstate.sources.log.files_of", lambda spark, root: HadoopFiles(spark, f"file://{root}"))
    schema = state(items=(0, "k string", "v string"))
    store = Store.open(spark, schema, str(tmp_path / "s"))
    store.write(lambda tx: tx.items.put("a", "1"))
    store.write(lambda tx: tx.items.put_df(spark.createDataFrame([("b", "2")], "k string, v string")))
    store.compact()
    store.write(lambda tx: tx.items.delete("a"))
    again = Store.open(spark, schema, str(tmp_path / "s"))
    assert {r.k: r.v for r in again.read()["items"].collect()} == {"b": "2"}


def test_a_machine_local_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from keelstate.errors import IoError
    from keelstate.sources.files import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(IoError, match="spark.checkpoint.dir"):
        shared_folder(unset)
    given = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://x/shared/"), sparkContext=context)
    assert shared_folder(given) == "hdfs://x/shared"
