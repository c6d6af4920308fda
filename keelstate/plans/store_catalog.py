"""Queries of the catalogue that go through a store: transactions, logs, snapshots, recovery and codecs.

Each makes its store in the shared folder (or in memory), changes it through the public interface and
returns what is then read. Tables go in as tables; what is put row by row are the few rows of nation
and region. Faults are made through the log's own file interface, so any file system will do.
"""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstate import errors
from keelstate.async_store import AsyncStore
from keelstate.functions import keys as codecs
from keelstate.operators import overlay as algebra
from keelstate.operators import replay
from keelstate.operators.replay import DELETE, PUT
from keelstate.plans.catalog import _DELS, _DELTA, _LOG, _MERGED, _PUTS, _delta, _live, _newest, oplog, table
from keelstate.schema import collection, derive, state
from keelstate.sources import binary_log
from keelstate.sources.backend import FolderBackend, NullBackend
from keelstate.sources.files import shared_folder
from keelstate.store import FlushPolicy, Store, Transaction
from keelstate.streaming.ingest import ingest

APP = state(
    accounts=(0, "c_custkey long", "c_acctbal double"),
    nations=(1, "n_nationkey int", "n_name string"),
    regions=(2, "r_regionkey int", "r_name string", False),
)
EVENTS = state(events=(0, "k long", "seq long, event_type string, value double"))
#: Accounts whose key may come in several rows: these are told by a number.
COPIES = state(accounts=(0, "c_custkey long, copy int", "c_acctbal double"))
COUNTERS = state(counters=(0, "user_id long, event_type string", "n long", False))
EPOCHS = state(events=(0, "event_id long", "epoch long"))
#: Longer than any query: what is durable before was asked for.
LATER = FlushPolicy.grouped(600)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()


def _regions(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()


def _put(rows: DataFrame, where: str = "true", name: str = "accounts") -> Callable[[Transaction], None]:
    return lambda tx: getattr(tx, name).put_df(rows.filter(where))


# opening and backends


def store_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.memory(spark, APP)
    store.write(_put(_accounts(spark, sf_dir)))
    return store.read()["accounts"]


def store_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _folder(spark), _accounts(spark, sf_dir)
    with Store.open(spark, APP, path) as store:
        store.write(_put(rows))
        store.write(lambda tx: tx.accounts.delete_df(rows.filter("c_custkey % 10 = 1").select("c_custkey")))
        store.write(_put(rows.withColumn("c_acctbal", F.col("c_acctbal") + 100), "c_custkey % 10 = 0"))
    return Store.open(spark, APP, path).read()["accounts"]


def store_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = FolderBackend(spark, _folder(spark))
    store = Store.with_backend(spark, APP, backend)
    for third in range(3):
        store.write(_put(_accounts(spark, sf_dir), f"c_custkey % 3 = {third}"))
    return Store.with_backend(spark, APP, store.backend).read()["accounts"]


def store_null_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.with_backend(spark, APP, NullBackend())
    store.write(_put(_accounts(spark, sf_dir)))
    again = Store.with_backend(spark, APP, store.backend).read()
    return spark.createDataFrame([(store.read().count("accounts"), again.count("accounts"), again.is_empty("accounts"))], "n_seen long, n_after long, empty boolean")


def store_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _folder(spark), _accounts(spark, sf_dir)

    async def work() -> None:
        store = await AsyncStore.open(spark, APP, path)
        await asyncio.gather(*(store.clone().write(_put(rows, f"c_custkey % 3 = {third}")) for third in range(3)))
        await store.write_durable(lambda tx: tx.accounts.delete_df(rows.filter("c_custkey % 10 = 1").select("c_custkey")))
        await store.flush()
        await store.close()

    asyncio.run(work())
    return Store.open(spark, APP, path).read()["accounts"]


def store_async_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    async def work() -> DataFrame:
        store = await AsyncStore.open(spark, APP, _folder(spark))
        held = store.read()
        await store.write(_put(_accounts(spark, sf_dir)))
        return held["accounts"].agg(F.lit(0).alias("at"), F.count("*").alias("n")).unionByName(
            store.read()["accounts"].agg(F.lit(1).alias("at"), F.count("*").alias("n"))
        )

    return asyncio.run(work())


def store_backend_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is the store's backend: its state as of the first commit."""
    store = Store.open(spark, APP, _folder(spark))
    for half in range(2):
        store.write(_put(_accounts(spark, sf_dir), f"c_custkey % 2 = {half}"))
    return store.backend.state(upto=1)["accounts"]


# transactions


def _nation_changes(spark: SparkSession, sf_dir: str, seen: Callable[[Transaction], DataFrame]) -> DataFrame:
    """What a transaction sees that renamed every fifth nation, added some and deleted those after them."""
    rows = _nations(spark, sf_dir)
    store = Store.memory(spark, APP)
    store.write(lambda tx: [tx.nations.put(r.n_nationkey, r.n_name) for r in rows])

    def body(tx: Transaction) -> DataFrame:
        for r in rows:
            if r.n_nationkey % 5 == 0:
                tx.nations.put(r.n_nationkey, r.n_name.lower())
                tx.nations.put(r.n_nationkey + 100, r.n_name)
            elif r.n_nationkey % 5 == 1:
                tx.nations.delete(r.n_nationkey)
        return seen(tx)

    return store.write(body)


_SEEN = """seen as (select 0 as src, n_nationkey, n_name from nation where n_nationkey % 5 > 1
    union all select 1, n_nationkey, lower(n_name) from nation where n_nationkey % 5 = 0
    union all select 1, n_nationkey + 100, n_name from nation where n_nationkey % 5 = 0)"""


def tx_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_changes(spark, sf_dir, lambda tx: tx.nations.iterate())


def tx_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_changes(spark, sf_dir, lambda tx: tx.nations.values())


def tx_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [r.n_nationkey * 2 for r in _nations(spark, sf_dir)]

    def seen(tx: Transaction) -> DataFrame:
        return spark.createDataFrame([(k, k in tx.nations, tx.nations.get(k)) for k in keys], "n_nationkey int, present boolean, n_name string")

    return _nation_changes(spark, sf_dir, seen)


def tx_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(tx: Transaction) -> DataFrame:
        before = tx.accounts.is_empty()
        tx.accounts.put_df(_accounts(spark, sf_dir))
        return spark.createDataFrame([(before, tx.accounts.is_empty(), tx.nations.is_empty())], "before boolean, after boolean, other boolean")

    return Store.memory(spark, APP).write(body)


def tx_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that share a key the greatest by a column stays; single puts go over them."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("r_name"), "n_nationkey")
    store = Store.memory(spark, APP)

    def body(tx: Transaction) -> None:
        tx.regions.put_df(rows, order_by="n_nationkey")
        tx.regions.put(0, "first")
        tx.regions.put(99, "new")

    store.write(body)
    return store.read()["regions"]


def tx_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key that is deleted, single or in a table, with whether it was there."""
    store, rows = Store.memory(spark, APP), _accounts(spark, sf_dir)
    store.write(_put(rows))

    def body(tx: Transaction) -> DataFrame:
        single = [(-k, tx.accounts.delete(-k)) for k in (1, 2)]
        found = tx.accounts.delete_df(rows.select((F.col("c_custkey") * 2).alias("c_custkey")))
        return found.unionByName(spark.createDataFrame(single, "c_custkey long, existed boolean"))

    return store.write(body)


def tx_retain_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.open(spark, APP, _folder(spark))
    store.write(_put(_accounts(spark, sf_dir)))
    return store.write(lambda tx: tx.accounts.retain(F.col("c_acctbal") > 0))


def tx_retain_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    with Store.open(spark, APP, path) as store:
        store.write(_put(_accounts(spark, sf_dir)))
        store.write(lambda tx: tx.accounts.retain(F.col("c_acctbal") > 0))
    return Store.open(spark, APP, path).read()["accounts"]


def tx_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = Store.memory(spark, APP), _regions(spark, sf_dir)
    store.write(lambda tx: [tx.regions.put(r.r_regionkey, r.r_name) for r in rows])
    done = store.write(lambda tx: [(2 * r.r_regionkey, tx.regions.update(2 * r.r_regionkey, str.lower)) for r in rows])
    return spark.createDataFrame(done, "r_regionkey int, updated boolean").join(store.read()["regions"], "r_regionkey", "full")


def rmw_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that each transaction reads and puts back, raised by its own part of the events."""
    store, events = Store.open(spark, COUNTERS, _folder(spark)), table(spark, sf_dir, "events")
    for part in range(3):

        def body(tx: Transaction, part: int = part) -> None:
            new = events.filter(f"event_id % 3 = {part}").groupBy("user_id", "event_type").agg(F.count("*").alias("more"))
            raised = new.join(tx.counters.df(), ["user_id", "event_type"], "left")
            tx.counters.put_df(raised.select("user_id", "event_type", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n")))

        store.write(body)
    return store.read()["counters"]


def tx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction's operations, collection by collection in the order of the schema."""
    tx = Transaction(spark, Store.memory(spark, APP).read())
    for r in _regions(spark, sf_dir):
        tx.regions.put(r.r_regionkey, r.r_name)
    tx.accounts.put_df(_accounts(spark, sf_dir))
    tx.regions.delete(0)
    parts = [(i, p.collection, len(p.ops) if hasattr(p, "ops") else p.rows.count()) for i, p in enumerate(tx.finish())]
    return spark.createDataFrame(parts, "pos int, collection string, n long")


# commits


def write_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = Store.open(spark, APP, _folder(spark)), _accounts(spark, sf_dir)
    store.write(_put(rows, "c_custkey % 2 = 0"))

    def body(tx: Transaction) -> None:
        tx.accounts.delete_df(rows.select("c_custkey"))
        tx.accounts.put(-1, 0.0)
        raise errors.Invalid("transaction", "given up")

    try:
        store.write(body)
    except errors.Invalid:
        pass
    return store.read()["accounts"]


def write_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of a collection without an order, merged over what stands there and read back from disk."""
    path, rows = _folder(spark), _regions(spark, sf_dir)
    with Store.open(spark, APP, path) as store:
        store.write(lambda tx: [tx.regions.put(r.r_regionkey, r.r_name) for r in rows])
        store.write(lambda tx: [tx.regions.put(r.r_regionkey, r.r_name.lower()) if r.r_regionkey % 2 else tx.regions.delete(r.r_regionkey) for r in rows[:4]])
    return Store.open(spark, APP, path).read()["regions"]


def write_durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside a grouped store that isn't closed: a durable write brings all before it to disk, a later one isn't there."""
    path, rows = _folder(spark), _accounts(spark, sf_dir)
    store = Store.open(spark, APP, path)
    store.set_flush_policy(LATER)
    store.write(_put(rows, "c_custkey % 3 = 0"))
    store.write_durable(_put(rows, "c_custkey % 3 = 1"))
    store.write(_put(rows, "c_custkey % 3 = 2"))
    return Store.open(spark, APP, path).read()["accounts"]


def _copies(rows: DataFrame) -> DataFrame:
    """Rows with their number among those of their key."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("c_custkey").orderBy("c_acctbal")))


def commit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta of the overlay queries as a durable commit over the whole table.

    A key that the delta puts twice keeps both rows, and one that it deletes and puts is put: all rows that
    stood under its keys go, then its puts are made.
    """
    path, (rows, delta) = _folder(spark), _delta(spark, sf_dir)
    touched = delta.puts.select("c_custkey").unionByName(delta.deletes)

    def body(tx: Transaction) -> None:
        tx.accounts.delete_df(tx.accounts.df().join(touched, "c_custkey", "left_semi").select("c_custkey", "copy"))
        tx.accounts.put_df(_copies(delta.puts))

    with Store.open(spark, COPIES, path) as store:
        store.write(_put(_copies(rows)))
        store.write(body)
    return Store.open(spark, COPIES, path).read()["accounts"].drop("copy")


def derived_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collections that a class declares, and a derived view of its state."""

    @derive
    class Shop:
        accounts = collection(0, "c_custkey long", "c_acctbal double")
        regions = collection(7, "r_regionkey int", "r_name string", False)
        note = "not a collection"

        def in_debt(state_):
            return state_["accounts"].filter("c_acctbal < 0")

    store = Store.memory(spark, Shop)
    store.write(_put(_accounts(spark, sf_dir)))
    counted = store.read()["in_debt"].agg(F.lit(-1).alias("id"), F.lit("in_debt").alias("name"), F.count("*").cast("string").alias("about"))
    found = [(c["id"], c["name"], f"{c['key']} {c['value']} {str(c['ordered']).lower()}") for c in Shop.described()]
    return spark.createDataFrame(found, "id int, name string, about string").unionByName(counted)


# overlays as values


def overlay_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts over an overlay replace its puts and undo its deletes."""
    rows, delta = _delta(spark, sf_dir)
    again = rows.filter("c_custkey % 20 < 2").withColumn("c_acctbal", -F.col("c_acctbal"))
    return algebra.apply(rows, algebra.put(delta, again))


def overlay_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    gone = rows.select(F.explode(F.array("c_custkey", F.col("c_custkey") + 100000)).alias("c_custkey")).filter("c_custkey % 4 = 0")
    return algebra.apply(rows, algebra.delete(delta, rows, gone))


def overlay_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    nothing = algebra.Overlay(rows.limit(0), rows.limit(0).select("c_custkey"), ["c_custkey"])
    return spark.createDataFrame([(delta.is_empty(), nothing.is_empty())], "changed boolean, unchanged boolean")


# the log


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    with Store.open(spark, APP, path) as store:
        for r in _regions(spark, sf_dir):
            store.write(lambda tx: tx.regions.put(r.r_regionkey, r.r_name))
    store = Store.open(spark, APP, path)
    return spark.createDataFrame([(store.log.count, store.read().seq)], "n_entries long, seq long")


def log_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two commits left in the log: operations by commit and kind."""
    store, rows = Store.open(spark, APP, _folder(spark)), _accounts(spark, sf_dir)
    store.write(_put(rows))
    store.write(lambda tx: (tx.accounts.put(-1, 1.0), tx.accounts.delete_df(rows.filter("c_acctbal < 0").select("c_custkey"))))
    paths = [store.log.files.uri(part["path"]) for commit in store.log.commits for part in commit["parts"]]
    log = spark.read.schema(APP["accounts"].log_schema).parquet(*paths)
    return log.groupBy("commit_seq", "op_idx", "op_kind").agg(F.count("*").alias("n"))


def log_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four commits the third is lost: the first two stand, and a commit made then stays."""
    path, rows = _folder(spark), _accounts(spark, sf_dir)
    with Store.open(spark, APP, path) as store:
        for part in range(4):
            store.write(_put(rows, f"c_custkey % 4 = {part}"))
        store.log.files.remove(f"commits/{3:020d}.json")
    with Store.open(spark, APP, path) as store:
        store.write(lambda tx: tx.accounts.put(-1, 0.5))
    return Store.open(spark, APP, path).read()["accounts"]


def log_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data that changed behind a commit ends the valid run before it."""
    path, rows = _folder(spark), _accounts(spark, sf_dir)
    with Store.open(spark, APP, path) as store:
        for part in range(2):
            store.write(_put(rows, f"c_custkey % 2 = {part}"))
        files, part = store.log.files, store.log.commits[1]["parts"][0]["path"]
        for name in files.sizes(part):
            content = bytearray(files.read(f"{part}/{name}"))
            content[len(content) // 2] ^= 0xFF
            files.remove(f"{part}/{name}")
            files.remove(f"{part}/.{name}.crc")
            files.publish(f"{part}/{name}", bytes(content))
    return Store.open(spark, APP, path).read()["accounts"]


def snapshot_plus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of the first events as a stored snapshot, the later ones as a commit after it, opened anew."""
    path, log = _folder(spark), oplog(spark, sf_dir)
    with Store.open(spark, EVENTS, path) as store:
        store.write(_put(replay.live(replay.prefix(log, "seq", 9899), ["k"], _newest()), name="events"))
        store.compact()
        newest = replay.latest(log.filter("seq >= 9900"), ["k"], _newest())

        def body(tx: Transaction) -> None:
            tx.events.delete_df(newest.filter(F.col("kind") == DELETE).select("k"))
            tx.events.put_df(newest.filter(F.col("kind") == PUT))

        store.write(body)
    return Store.open(spark, EVENTS, path).read()["events"]


def snapshot_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    with Store.open(spark, APP, path, snapshot_threshold=3) as store:
        for r in _regions(spark, sf_dir):
            store.write(lambda tx: tx.regions.put(r.r_regionkey, r.r_name))
    store = Store.open(spark, APP, path, snapshot_threshold=3)
    return spark.createDataFrame([(store.log.snapshot["seq"], store.log.count, store.read().count("regions"))], "snapshot long, after long, n long")


def snapshot_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three compactions leave what the versions in use may need: one commit and two snapshots."""
    store, rows = Store.open(spark, APP, _folder(spark)), _accounts(spark, sf_dir)
    for part in range(3):
        store.write(_put(rows, f"c_custkey % 3 = {part}"))
        store.compact()
    marks = [n for n in store.log.files.names("snapshots") if n.endswith(".json")]
    return spark.createDataFrame([(len(store.log.files.names("commits")), len(marks), store.read().count("accounts"))], "n_commits long, n_snapshots long, n long")


def snapshot_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental save for each of five epochs of events, a snapshot after every second one."""
    path, events = _folder(spark), table(spark, sf_dir, "events")
    with Store.open(spark, EPOCHS, path, snapshot_threshold=2) as store:
        for epoch in range(5):
            store.write(_put(events.select("event_id", F.lit(epoch).cast("long").alias("epoch")), f"event_id % 5 = {epoch}", "events"))
    store = Store.open(spark, EPOCHS, path)
    rows = store.read()["events"].groupBy("epoch").agg(F.count("*").alias("n"))
    return rows.withColumn("in_snapshot", F.col("epoch") < store.log.snapshot["seq"])


def snapshot_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.open(spark, APP, _folder(spark))
    for r in _regions(spark, sf_dir)[:2]:
        store.write(lambda tx: tx.regions.put(r.r_regionkey, r.r_name))
        store.compact()
    for name in store.log.files.names("snapshots"):
        if name.endswith(".json"):
            store.log.files.remove(f"snapshots/{name}")
            store.log.files.publish(f"snapshots/{name}", b"{")
    try:
        Store.open(spark, APP, store.log.files.root)
        message = "opened"
    except errors.LogCorrupted as error:
        message = str(error)
    return spark.createDataFrame([(message, len(store.log.files.names("quarantine")))], "message string, n_aside long")


def binary_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations through a binary log file: two entries, a cut third, read back and folded by decoded keys."""
    rows, number = _nations(spark, sf_dir), codecs.NUMBERS["u32"]
    puts = [(PUT, 1, number.to_bytes(r.n_nationkey), r.n_name.encode()) for r in rows]
    gone = [(DELETE, 1, number.to_bytes(r.n_nationkey), None) for r in rows if r.n_nationkey % 3 == 0]
    data = binary_log.header() + binary_log.entry(puts) + binary_log.entry(gone) + binary_log.entry(puts)[:-3]
    path = _folder(spark)
    FolderBackend(spark, path).files.publish("log.bin", data)
    log = binary_log.read(spark.read.format("binaryFile").load(f"{path}/log.bin"))
    order = [F.col("commit_seq").desc(), F.col("op_idx").desc()]
    live = replay.live(replay.converted(log, "key", number.decode), ["key"], order)
    return live.select(F.col("key").cast("int").alias("n_nationkey"), codecs.STRING.decode(F.col("value")).alias("n_name"), "commit_seq")


def binary_log_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, out = binary_log.header(), []
    for case, data in (("short", good[:7]), ("magic", b"XXXX" + good[4:]), ("version", good[:4] + b"\x63" + good[5:]), ("good", good)):
        try:
            binary_log.check_header(data)
            out.append((case, "valid"))
        except errors.LogCorrupted as error:
            out.append((case, str(error)))
    return spark.createDataFrame(out, "case string, message string")


# replay of stored keys


def replay_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oplog(spark, sf_dir).withColumn("k", F.concat(F.lit("é"), F.col("k")).cast("binary"))
    return replay.live(replay.converted(log, "k", replay.checked_text), ["k"], _newest())


def replay_byte_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oplog(spark, sf_dir).withColumn("k", codecs.BYTES.encode(F.concat(F.lit("u"), F.col("k")).cast("binary")))
    return replay.live(log, ["k"], _newest()).withColumn("k", F.hex(codecs.BYTES.decode(F.col("k"))))


def replay_converted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oplog(spark, sf_dir).withColumn("k", codecs.NUMBERS["u64"].encode(F.col("k")))
    return replay.live(replay.converted(log, "k", lambda k: codecs.NUMBERS["u64"].decode(k).cast("long")), ["k"], _newest())


def replay_bad_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored key that isn't UTF-8 is an error, in a deletion too."""
    out = []
    for kind in (PUT, DELETE):
        log = oplog(spark, sf_dir).limit(1).select("seq", F.unhex(F.lit("FF41")).alias("k"), F.lit(kind).alias("kind"))
        try:
            replay.converted(log, "k", replay.checked_text).collect()
            out.append((kind, "read"))
        except Exception as error:
            text = "WAL corrupted at offset 0: invalid UTF-8 key"
            out.append((kind, text if text in str(error) else "other"))
    return spark.createDataFrame(out, "kind string, message string")


# grouped durability


def group_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grouped writes are seen at once and reach the disk as one commit."""
    path, events = _folder(spark), table(spark, sf_dir, "events")
    with Store.open(spark, EPOCHS, path) as store:
        store.set_flush_policy(LATER)
        for part in range(3):
            store.write(_put(events.select("event_id", F.lit(part).cast("long").alias("epoch")), f"event_id % 3 = {part}", "events"))
        seen, before = store.read().count("events"), len(store.log.files.names("commits"))
        store.flush(600)
        after = len(store.log.files.names("commits"))
        durable = Store.open(spark, EPOCHS, path).read().count("events")
    return spark.createDataFrame([(seen, before, after, durable)], "n_seen long, commits_before long, commits_after long, n_durable long")


def flush_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on disk after each change of policy, and after the store is left."""
    path, rows, out = _folder(spark), _accounts(spark, sf_dir), []

    def durable(at: str) -> None:
        out.append((at, Store.open(spark, APP, path).read().count("accounts")))

    with Store.open(spark, APP, path) as store:
        store.write(_put(rows, "c_custkey % 4 = 0"))
        durable("immediate")
        store.set_flush_policy(LATER)
        store.write(_put(rows, "c_custkey % 4 = 1"))
        durable("grouped")
        store.set_flush_policy(FlushPolicy.immediate())
        durable("changed")
        store.set_flush_policy(LATER)
        store.write(_put(rows, "c_custkey % 4 = 2"))
    durable("left")
    return spark.createDataFrame(out, "at string, n long")


def flush_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed flush is told once and loses nothing."""
    store = Store.open(spark, APP, _folder(spark))
    store.set_flush_policy(LATER)
    sync, failures = store.log.sync, [OSError("disk is full")]

    def failing() -> None:
        if failures:
            raise failures.pop()
        sync()

    store.log.sync = failing
    store.write(_put(_accounts(spark, sf_dir)))
    try:
        store.flush(600)
        message = "flushed"
    except errors.IoError as error:
        message = str(error)
    told_again = store.flush_error() is not None
    store.flush(600)
    store.close()
    n = Store.open(spark, APP, store.log.files.root).read().count("accounts")
    return spark.createDataFrame([(message, told_again, n)], "message string, told_again boolean, n long")


def store_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.open(spark, APP, _folder(spark))
    store.set_flush_policy(LATER)
    store.write(_put(_accounts(spark, sf_dir)))
    store.close()
    try:
        store.write(lambda tx: tx.accounts.put(-1, 0.0))
        message = "written"
    except errors.Invalid as error:
        message = str(error)
    n = Store.open(spark, APP, store.log.files.root).read().count("accounts")
    return spark.createDataFrame([(message, n)], "message string, n long")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of operations into a store, micro-batch by micro-batch."""
    path, schema = _folder(spark), table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = stream.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("k"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("kind"), "event_type", "value",
    )
    with Store.open(spark, EVENTS, f"{path}/store") as store:
        ingest(log, store, "events", ["seq"], f"{path}/checkpoint", availableNow=True).awaitTermination()
    return Store.open(spark, EVENTS, f"{path}/store").read()["events"]


# codecs

#: Bytes and sign of each whole-number codec.
_NUMBERS = {"u8": (1, False), "u16": (2, False), "u32": (4, False), "u64": (8, False), "i8": (1, True), "i16": (2, True), "i32": (4, True), "i64": (8, True)}


def _number_keys(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    n, signed = _NUMBERS[name]
    wide = (F.col("c_custkey") * 2654435761).cast("decimal(20,0)")
    modulus = F.lit(str(1 << 8 * n if n < 8 else 1 << 62)).cast("decimal(20,0)")
    key = F.pmod(wide, modulus) - (F.lit(str(1 << 8 * n - 1 if n < 8 else 1 << 61)).cast("decimal(20,0)") if signed else F.lit(0))
    return table(spark, sf_dir, "customer").select(F.lit(name).alias("codec"), "c_custkey", key.cast("decimal(20,0)").alias("key"))


def _number_sql(name: str) -> str:
    n, signed = _NUMBERS[name]
    modulus, half = (1 << 8 * n, 1 << 8 * n - 1) if n < 8 else (1 << 62, 1 << 61)
    key = f"((c_custkey::hugeint * 2654435761) % {modulus}::hugeint - {half if signed else 0}::hugeint)"
    digits = " || ".join(f"printf('%02X', ((k + {1 << 8 * n}::hugeint) % {1 << 8 * n}::hugeint // {1 << 8 * i}::hugeint % 256)::int)" for i in range(n))
    return f"select '{name}' as codec, c_custkey, k::varchar as key, {digits} as key_hex from (select c_custkey, {key} as k from customer)"


def key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte form of a number of each codec for each customer, and the number that it decodes to."""
    parts = None
    for name in _NUMBERS:
        codec, rows = codecs.NUMBERS[name], _number_keys(spark, sf_dir, name)
        stored = rows.select("codec", "c_custkey", codec.encode(F.col("key")).alias("data"))
        part = stored.select("codec", "c_custkey", codec.decode(F.col("data")).cast("string").alias("key"), F.hex("data").alias("key_hex"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def key_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each customer in bytes and back: version 4, version 6 and either."""
    k = F.col("c_custkey")
    v4 = F.concat_ws(".", F.lit("10"), F.floor(k / 65536) % 256, F.floor(k / 256) % 256, k % 256)
    v6 = F.concat(F.lit("2001:db8::"), F.lower(F.hex(k % 60000 + 1)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", v4.alias("v4"), v6.alias("v6"))
    parts = None
    for name, codec, column in (("ipv4", codecs.IPV4, "v4"), ("ipv6", codecs.IPV6, "v6"), ("ip4", codecs.IP, "v4"), ("ip6", codecs.IP, "v6")):
        stored = rows.select(F.lit(name).alias("codec"), "c_custkey", codec.encode(F.col(column)).alias("data"))
        part = stored.select("codec", "c_custkey", codec.decode(F.col("data")).alias("key"), F.hex("data").alias("key_hex"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def key_text_and_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, data = codecs.STRING, codecs.BYTES
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("é"), F.col("c_name")).alias("key"))
    stored = rows.select("c_custkey", text.encode(F.col("key")).alias("t"), data.encode(F.reverse("key").cast("binary")).alias("b"))
    return stored.select("c_custkey", F.hex("t").alias("text_hex"), text.decode(F.col("t")).alias("text"), F.hex(data.decode(F.col("b"))).alias("bytes_hex"))


def key_decode_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested pairs of text, number and text in bytes and back."""
    codec = codecs.pair(codecs.STRING, codecs.pair(codecs.NUMBERS["u16"], codecs.STRING))
    key = F.struct(F.col("c_mktsegment").alias("_1"), F.struct(F.col("c_nationkey").alias("_1"), F.col("c_name").alias("_2")).alias("_2"))
    stored = table(spark, sf_dir, "customer").select(codec.encode(key).alias("data"))
    found = stored.select("data", codec.decode(F.col("data")).alias("key"))
    return found.select(F.hex("data").alias("key_hex"), F.col("key._1").alias("segment"), F.col("key._2._1").alias("nation"), F.col("key._2._2").alias("name"))


def key_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keys that can't be decoded say, as single keys."""
    both, out = codecs.pair(codecs.STRING, codecs.STRING), []
    cases = {
        "u16": (codecs.NUMBERS["u16"], b"\1"), "string": (codecs.STRING, b"\xff"), "ipv4": (codecs.IPV4, b"\1\2"), "ipv6": (codecs.IPV6, b""),
        "ip": (codecs.IP, b"\5abcd"), "pair": (both, b"\1"), "cut pair": (both, b"\5" + bytes(7) + b"ab"),
    }
    for case, (codec, data) in cases.items():
        try:
            codec.from_bytes(data)
            out.append((case, "decoded"))
        except errors.LogCorrupted as error:
            out.append((case, str(error)))
    return spark.createDataFrame(out, "case string, message string")


def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        errors.IoError("cut"), errors.CodecError("bad"), errors.NotFound("user", 7), errors.AlreadyExists("user", 7),
        errors.Invalid("age", "too low"), errors.LogCorrupted(16, "checksum"), errors.SnapshotVersion(2, 1),
    ]
    return spark.createDataFrame([(type(e).__name__, str(e), isinstance(e, errors.StoreError)) for e in found], "kind string, message string, ours boolean")


def read_missing_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.memory(spark, APP)
    store.write(lambda tx: [tx.regions.put(r.r_regionkey, r.r_name) for r in _regions(spark, sf_dir)])
    out = []
    for key in (0, 1, 77):
        try:
            out.append((key, store.read().at("regions", key)))
        except errors.NotFound as error:
            out.append((key, str(error)))
    return spark.createDataFrame(out, "r_regionkey int, found string")


QUERIES = {
    f.__name__: f
    for f in (
        store_memory, store_reopen, store_backend, store_null_backend, store_async, store_async_read, store_backend_log,
        tx_iterate, tx_values, tx_get, tx_is_empty, tx_put, tx_delete, tx_retain_removed, tx_retain_kept, tx_update, rmw_counter,
        tx_parts, write_rollback, write_unordered, write_durable, commit_delta, derived_schema, overlay_put, overlay_delete,
        overlay_is_empty, log_entries, log_operations, log_recovery, log_checksum, snapshot_plus_log, snapshot_threshold,
        snapshot_generations, snapshot_epochs, snapshot_unreadable, binary_log_fold, binary_log_header, replay_text_keys,
        replay_byte_keys, replay_converted_keys, replay_bad_text, group_commit, flush_policies, flush_error, store_close,
        stream_ingest, key_numbers, key_addresses, key_text_and_bytes, key_decode_tuple, key_errors, error_texts, read_missing_error,
    )
}


def _values(columns: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) as t({columns})"


_ACCOUNTS = "select c_custkey, c_acctbal from customer"

ORACLES = {
    "store_memory": _ACCOUNTS,
    "store_reopen": "select c_custkey, case when c_custkey % 10 = 0 then c_acctbal + 100 else c_acctbal end as c_acctbal from customer where c_custkey % 10 <> 1",
    "store_backend": _ACCOUNTS,
    "store_null_backend": "select count(*) as n_seen, 0::bigint as n_after, true as empty from customer",
    "store_async": f"{_ACCOUNTS} where c_custkey % 10 <> 1",
    "store_async_read": "select 0 as at, 0::bigint as n union all select 1, count(*) from customer",
    "store_backend_log": f"{_ACCOUNTS} where c_custkey % 2 = 0",
    "tx_iterate": f"with {_SEEN} select src, n_nationkey, n_name from seen",
    "tx_values": f"with {_SEEN} select n_name from seen",
    "tx_get": f"""with {_SEEN}, asked as (select 2 * n_nationkey as n_nationkey from nation)
        select n_nationkey, s.n_name is not null as present, s.n_name from asked left join seen s using (n_nationkey)""",
    "tx_is_empty": "select true as before, false as after, true as other",
    "tx_put": """select n_regionkey as r_regionkey, max_by(n_name, n_nationkey) as r_name from nation where n_regionkey <> 0 group by 1
        union all select 0, 'first' union all select 99, 'new'""",
    "tx_delete": """select 2 * c.c_custkey as c_custkey, h.c_custkey is not null as existed from customer c left join customer h on h.c_custkey = 2 * c.c_custkey
        union all select -1, false union all select -2, false""",
    "tx_retain_removed": "select c_custkey from customer where not c_acctbal > 0",
    "tx_retain_kept": f"{_ACCOUNTS} where c_acctbal > 0",
    "tx_update": """select r_regionkey, d.updated, case when d.updated then lower(r.r_name) else r.r_name end as r_name from region r
        full join (select 2 * r_regionkey as r_regionkey, 2 * r_regionkey in (select r_regionkey from region) as updated from region) d using (r_regionkey)""",
    "rmw_counter": "select user_id, event_type, count(*) as n from events group by 1, 2",
    "tx_parts": """select 0 as pos, 'accounts' as collection, count(*) as n from customer union all select 1, 'regions', count(*) + 1 from region""",
    "write_rollback": f"{_ACCOUNTS} where c_custkey % 2 = 0",
    "write_unordered": """select r_regionkey, case when pos <= 4 then lower(r_name) else r_name end as r_name
        from (select *, row_number() over (order by r_regionkey) as pos from region) where pos > 4 or r_regionkey % 2 = 1""",
    "write_durable": f"{_ACCOUNTS} where c_custkey % 3 < 2",
    "commit_delta": f"{_DELTA}, {_MERGED} select c_custkey, c_acctbal from merged",
    "derived_schema": """select 0 as id, 'accounts' as name, 'struct<c_custkey:bigint> struct<c_acctbal:double> true' as about
        union all select 7, 'regions', 'struct<r_regionkey:int> struct<r_name:string> false'
        union all select -1, 'in_debt', count(*)::varchar from customer where c_acctbal < 0""",
    "overlay_put": f"""with {_PUTS}, {_DELS}, {_MERGED}, again as (select c_custkey, -c_acctbal as c_acctbal from customer where c_custkey % 20 < 2)
        select c_custkey, c_acctbal from merged where c_custkey not in (select c_custkey from again) union all select * from again""",
    "overlay_delete": f"{_DELTA}, {_MERGED} select c_custkey, c_acctbal from merged where c_custkey % 4 <> 0",
    "overlay_is_empty": "select count(*) = 0 as changed, true as unchanged from customer where c_custkey % 10 < 2 or c_custkey < 50",
    "log_entries": "select count(*) as n_entries, count(*) as seq from region",
    "log_operations": """select 1::bigint as commit_seq, 1::bigint as op_idx, 'put' as op_kind, count(*) as n from customer
        union all select 2, 1, 'put', 1 union all select 2, 2, 'delete', count(*) from customer where c_acctbal < 0 having count(*) > 0""",
    "log_recovery": f"{_ACCOUNTS} where c_custkey % 4 < 2 union all select -1, 0.5",
    "log_checksum": f"{_ACCOUNTS} where c_custkey % 2 = 0",
    "snapshot_plus_log": f"""with suffix as ({_LOG} where event_id >= 9900)
        select * from ({_live(f'{_LOG} where event_id < 9900')}) where k not in (select k from suffix)
        union all select * from ({_live('select * from suffix')})""",
    "snapshot_threshold": "select count(*) // 3 * 3 as snapshot, count(*) % 3 as after, count(*) as n from region",
    "snapshot_generations": "select 1::bigint as n_commits, 2::bigint as n_snapshots, count(*) as n from customer",
    "snapshot_epochs": "select event_id % 5 as epoch, count(*) as n, event_id % 5 < 4 as in_snapshot from events group by 1, 3",
    "snapshot_unreadable": "select 'WAL corrupted at offset 2: unreadable snapshot: undecodable snapshot' as message, 0::bigint as n_aside",
    "binary_log_fold": "select n_nationkey, n_name, 1::bigint as commit_seq from nation where n_nationkey % 3 <> 0",
    "binary_log_header": _values(
        '"case", message', "('short', 'WAL corrupted at offset 0: file too short for a header')", "('magic', 'WAL corrupted at offset 0: bad magic')",
        "('version', 'WAL corrupted at offset 4: unsupported version 99')", "('good', 'valid')",
    ),
    "replay_text_keys": f"select seq, 'é' || k as k, event_type, value from ({_live(_LOG)})",
    "replay_byte_keys": f"select seq, hex('u' || k) as k, event_type, value from ({_live(_LOG)})",
    "replay_converted_keys": _live(_LOG),
    "replay_bad_text": _values("kind, message", *(f"('{kind}', 'WAL corrupted at offset 0: invalid UTF-8 key')" for kind in (PUT, DELETE))),
    "group_commit": "select count(*) as n_seen, 0::bigint as commits_before, 1::bigint as commits_after, count(*) as n_durable from events",
    "flush_policies": """select 'immediate' as at, count(*) as n from customer where c_custkey % 4 = 0
        union all select 'grouped', count(*) from customer where c_custkey % 4 = 0
        union all select 'changed', count(*) from customer where c_custkey % 4 < 2
        union all select 'left', count(*) from customer where c_custkey % 4 < 3""",
    "flush_error": "select 'I/O error: disk is full' as message, false as told_again, count(*) as n from customer",
    "store_close": "select 'invalid store: it is closed' as message, count(*) as n from customer",
    "stream_ingest": _live(_LOG),
    "key_numbers": " union all ".join(map(_number_sql, _NUMBERS)),
    "key_addresses": """with a as (select c_custkey, printf('10.%d.%d.%d', c_custkey // 65536 % 256, c_custkey // 256 % 256, c_custkey % 256) as v4,
            printf('0A%02X%02X%02X', c_custkey // 65536 % 256, c_custkey // 256 % 256, c_custkey % 256) as h4,
            '2001:db8::' || printf('%x', c_custkey % 60000 + 1) as v6, '20010DB8' || repeat('0', 20) || printf('%04X', c_custkey % 60000 + 1) as h6
            from customer)
        select 'ipv4' as codec, c_custkey, v4 as key, h4 as key_hex from a union all select 'ipv6', c_custkey, v6, h6 from a
        union all select 'ip4', c_custkey, v4, '04' || h4 from a union all select 'ip6', c_custkey, v6, '06' || h6 from a""",
    "key_text_and_bytes": "select c_custkey, hex('é' || c_name) as text_hex, 'é' || c_name as text, hex(reverse('é' || c_name)) as bytes_hex from customer",
    "key_decode_tuple": """select printf('%02X', strlen(c_mktsegment)) || repeat('00', 7) || hex(c_mktsegment) || '02' || repeat('00', 7)
            || printf('%02X%02X', c_nationkey % 256, c_nationkey // 256) || hex(c_name) as key_hex,
        c_mktsegment as segment, c_nationkey::int as nation, c_name as name from customer""",
    "key_errors": _values(
        '"case", message', "('u16', 'WAL corrupted at offset 0: expected 2 bytes')", "('string', 'WAL corrupted at offset 0: invalid UTF-8 key')",
        "('ipv4', 'WAL corrupted at offset 0: expected 4 bytes')", "('ipv6', 'WAL corrupted at offset 0: expected 16 bytes')",
        "('ip', 'WAL corrupted at offset 0: unknown discriminant of an address')", "('pair', 'WAL corrupted at offset 0: pair key too short')",
        "('cut pair', 'WAL corrupted at offset 0: pair key truncated')",
    ),
    "error_texts": _values(
        "kind, message, ours", "('IoError', 'I/O error: cut', true)", "('CodecError', 'codec error: bad', true)", "('NotFound', 'user not found: 7', true)",
        "('AlreadyExists', 'user already exists: 7', true)", "('Invalid', 'invalid age: too low', true)",
        "('LogCorrupted', 'WAL corrupted at offset 16: checksum', true)", "('SnapshotVersion', 'snapshot version mismatch: got 2, expected 1', true)",
    ),
    "read_missing_error": "select r_regionkey, r_name as found from region where r_regionkey < 2 union all select 77, 'regions not found: 77'",
}
