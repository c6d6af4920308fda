"""The queries of the catalogue, each by way of the engine's operators, with their oracle texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstate.functions import keys as codecs
from keelstate.operators import overlay as algebra
from keelstate.operators import replay
from keelstate.operators.overlay import Overlay
from keelstate.operators.replay import DELETE, PUT
from keelstate.schema import CollectionSpec, StateSchema, state
from keelstate.sources.files import shared_folder
from keelstate.store import Store, Version

#: The driver tables as collections.
TABLES = state(
    customer=(0, "c_custkey long", "c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    orders=(1, "o_orderkey long", "o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    nation=(2, "n_nationkey int", "n_name string, n_regionkey int"),
    region=(3, "r_regionkey int", "r_name string"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """A backend whose state are the driver tables, read where they lie."""

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def load(self, spark: SparkSession, schema: StateSchema) -> dict[str, DataFrame]:
        return {s.name: table(spark, self.sf_dir, s.name).select(*s.columns) for s in schema.collections}

    def save(self, state_: Version) -> None:
        raise NotImplementedError("the driver tables are only read")


def version(spark: SparkSession, sf_dir: str, schema: StateSchema = TABLES) -> Version:
    """The version that a store over the driver tables opens with."""
    return Store.with_backend(spark, schema, Tables(sf_dir)).read()


# reads


def read_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version(spark, sf_dir)["customer"]


def read_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of one key, by a point read; a state without it gives no row."""
    value = version(spark, sf_dir).get("customer", 42)
    return spark.createDataFrame([] if value is None else [(42, *value)], TABLES["customer"].schema)


def read_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    state_ = version(spark, sf_dir)
    return spark.createDataFrame([(int(state_.has("customer", -1)) + int(state_.get("customer", -1) is not None),)], "n long")


def read_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    state_ = version(spark, sf_dir)
    asked = state_["customer"].select((F.col("c_custkey") * 7).alias("c_custkey"))
    return state_.contains("customer", asked)


def read_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    state_ = version(spark, sf_dir)
    return spark.createDataFrame([(name, state_.count(name)) for name in ("customer", "orders")], "collection string, n long")


def read_ordered_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each row in the order of a text key, by ranges: no single task sorts all rows."""
    named = state(customer=(0, "c_name string, c_custkey long", "c_acctbal double"))
    by_name = version(spark, sf_dir, named).iterate("customer").select("c_name", "c_custkey")
    return numbered(by_name, ["c_name", "c_custkey"], "pos")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Positions from 1 in a total order: rows are sorted by ranges, and ranges counted.

    Sorted rows are stored once: sorted anew, the ranges would be cut from another sample, and rows and counts
    wouldn't agree. The count of each range is one row, so what is summed over is as small as the number of ranges.
    """
    shared_folder(rows.sparkSession)
    # The id has the range in its upper bits, the place inside it in the lower 33.
    stored = rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    ranged = stored.withColumn("__range", F.shiftright("__id", 33))
    counts = ranged.groupBy("__range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__before"))
    inside = F.col("__id") - F.shiftleft("__range", 33) + 1
    placed = ranged.join(F.broadcast(starts), "__range")
    return placed.withColumn(name, (F.col("__before") + inside).cast("long")).drop("__range", "__before", "__id")


def read_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version(spark, sf_dir)["orders"].filter("o_orderkey >= 100 and o_orderkey < 200")


def read_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version(spark, sf_dir)["customer"].filter("c_mktsegment = 'BUILDING' and c_acctbal > 0").select("c_custkey", "c_acctbal")


# overlays: puts of every tenth customer and of some new ones, deletes of the customers after them

_PUTS = """puts as (
    select c_custkey, c_acctbal + 100 as c_acctbal from customer where c_custkey % 10 = 0
    union all select c_custkey + 100000, 1.0::double from customer where c_custkey < 50)"""
_DELS = "dels as (select c_custkey from customer where c_custkey % 10 = 1)"
_MERGED = """merged as (
    select 0 as src, c_custkey, c_acctbal from customer c
     where not exists (select 1 from puts p where p.c_custkey = c.c_custkey)
       and not exists (select 1 from dels d where d.c_custkey = c.c_custkey)
    union all select 1 as src, c_custkey, c_acctbal from puts)"""
_ASKED = "asked as (select c_custkey * 3 as c_custkey from customer)"


def _puts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raised and new customers. Past 100,000 customers a key of both is put twice, and deleted ones are put too."""
    raised = rows.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    new = rows.filter("c_custkey < 50").select((F.col("c_custkey") + 100000).alias("c_custkey"), F.lit(1.0).alias("c_acctbal"))
    return raised, new


def _delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Overlay]:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    raised, new = _puts(rows)
    return rows, Overlay(raised.unionByName(new), rows.filter("c_custkey % 10 = 1").select("c_custkey"), ["c_custkey"])


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("c_custkey") * 3).alias("c_custkey"))


def overlay_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    return algebra.lookup(_asked(rows), rows, delta, ["c_acctbal"]).select("c_custkey", "c_acctbal")


def overlay_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    return algebra.lookup(_asked(rows), rows, delta, ["c_acctbal"]).select("c_custkey", "present")


def overlay_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    return algebra.apply(rows, delta).select("c_acctbal")


def overlay_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by (src, key). The SQL leaves rows of a key that is put twice in any order; here the raised one is first."""
    rows, delta = _delta(spark, sf_dir)
    raised, new = (part.withColumn("__put", F.lit(i)) for i, part in enumerate(_puts(rows)))
    placed = algebra.iterate(rows.withColumn("__put", F.lit(0)), Overlay(raised.unionByName(new), delta.deletes, delta.keys))
    return numbered(placed, ["src", "c_custkey", "__put", "c_acctbal"], "pos").drop("__put")


def overlay_delete_existed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    return algebra.existed(_asked(rows), rows, delta)


def overlay_retain_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    return algebra.retain(rows, delta, F.col("c_acctbal") > 0)[0]


def overlay_retain_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delta = _delta(spark, sf_dir)
    return algebra.retain(rows, delta, F.col("c_acctbal") > 0)[1]


def commit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.apply(*_delta(spark, sf_dir))


# replay


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an operation log: user is the key, an error deletes it."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("k"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("kind"),
        "event_type",
        "value",
    )


def _newest() -> list[Column]:
    return [F.col("seq").desc()]


def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.live(oplog(spark, sf_dir), ["k"], _newest())


def replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.live(replay.prefix(oplog(spark, sf_dir), "seq", 4999), ["k"], _newest())


def replay_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oplog(spark, sf_dir)
    return replay.live(log.unionByName(log), ["k"], _newest())


_ROUTES = StateSchema([CollectionSpec(i, f"c{i}", "k long", "event_type string, value double") for i in (0, 1)])


def replay_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oplog(spark, sf_dir).withColumn("collection", (F.col("seq") % 3).cast("int"))
    parts = [
        replay.live(part, ["k"], _newest()).agg(
            F.lit(_ROUTES[name].id).alias("collection"), F.count("*").alias("n"), F.sum("seq").alias("sum_seq")
        )
        for name, part in replay.routed(log, "collection", _ROUTES).items()
    ]
    return parts[0].unionByName(parts[1])


def replay_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oplog(spark, sf_dir).withColumn("tx", F.floor(F.col("seq") / 5))
    kept = replay.committed_only(log, "tx", F.col("event_type") == "signup").drop("tx")
    return replay.live(kept, ["k"], _newest())


def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nations(state_) -> DataFrame:
        held = state_["region"].join(state_["nation"], F.col("n_regionkey") == F.col("r_regionkey"))
        keys = F.array_sort(F.collect_list("n_nationkey"))
        return held.groupBy("r_regionkey").agg(F.array_join(F.transform(keys, lambda k: k.cast("string")), ",").alias("nations"))

    return version(spark, sf_dir, StateSchema(TABLES.collections, {"nations_of_region": nations}))["nations_of_region"]


def tuple_key_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    return replay.latest(rows, key, [F.col(c).desc() for c in rows.columns if c not in key])


# keys and counters


def key_encode_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = codecs.NUMBERS["u32"].encode(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(key).alias("key_hex"))


def key_encode_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = codecs.pair(codecs.STRING, codecs.STRING)
    key = both.encode(F.struct(F.col("lang").alias("_1"), F.col("source").alias("_2")))
    return table(spark, sf_dir, "documents").select("lang", "source").distinct().select("lang", "source", F.hex(key).alias("key_hex"))


QUERIES = {
    f.__name__: f
    for f in (
        read_scan, read_get, read_get_missing, read_contains, read_len, read_ordered_iter, read_key_range, read_value_filter,
        overlay_get, overlay_contains, overlay_values, overlay_iter, overlay_delete_existed, overlay_retain_kept,
        overlay_retain_removed, commit_overlay, replay_log, replay_prefix, replay_twice, replay_routing, replay_rollback,
        index_rebuild, tuple_key_lww, key_encode_u32, key_encode_tuple,
    )
}


def _live(rows: str) -> str:
    """The live state of an operation log in SQL."""
    return f"""select seq, k, event_type, value from (
        select *, row_number() over (partition by k order by seq desc) as r from ({rows})) where r = 1 and kind = 'put'"""


_LOG = "select event_id as seq, user_id as k, case when event_type = 'error' then 'delete' else 'put' end as kind, event_type, value from events"
_DELTA = f"with {_PUTS}, {_DELS}"

ORACLES = {
    "read_scan": "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
    "read_get": "select * from customer where c_custkey = 42",
    "read_get_missing": "select count(*) as n from customer where c_custkey = -1",
    "read_contains": """select a.c_custkey, c.c_custkey is not null as present
        from (select c_custkey * 7 as c_custkey from customer) a left join customer c on c.c_custkey = a.c_custkey""",
    "read_len": "select 'customer' as collection, count(*) as n from customer union all select 'orders', count(*) from orders",
    "read_ordered_iter": "select c_name, c_custkey, row_number() over (order by c_name, c_custkey) as pos from customer",
    "read_key_range": "select * from orders where o_orderkey >= 100 and o_orderkey < 200",
    "read_value_filter": "select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0",
    "overlay_get": f"""{_DELTA}, {_ASKED}
        select a.c_custkey, case when d.c_custkey is not null then null when p.c_custkey is not null then p.c_acctbal else c.c_acctbal end as c_acctbal
        from asked a left join customer c on c.c_custkey = a.c_custkey left join puts p on p.c_custkey = a.c_custkey
        left join dels d on d.c_custkey = a.c_custkey""",
    "overlay_contains": f"""{_DELTA}, {_ASKED}
        select a.c_custkey, d.c_custkey is null and (p.c_custkey is not null or c.c_custkey is not null) as present
        from asked a left join customer c on c.c_custkey = a.c_custkey left join puts p on p.c_custkey = a.c_custkey
        left join dels d on d.c_custkey = a.c_custkey""",
    "overlay_values": f"{_DELTA}, {_MERGED} select c_acctbal from merged",
    "overlay_iter": f"""{_DELTA}, {_MERGED}
        select src, c_custkey, c_acctbal, row_number() over (order by src, c_custkey) as pos from merged""",
    "overlay_delete_existed": f"""{_DELTA}, {_ASKED}
        select a.c_custkey, (p.c_custkey is not null or c.c_custkey is not null) as existed
        from asked a left join customer c on c.c_custkey = a.c_custkey left join puts p on p.c_custkey = a.c_custkey""",
    "overlay_retain_kept": f"{_DELTA}, {_MERGED} select c_custkey, c_acctbal from merged where c_acctbal > 0",
    "overlay_retain_removed": f"{_DELTA}, {_MERGED} select c_custkey from merged where not c_acctbal > 0",
    "commit_overlay": f"{_DELTA}, {_MERGED} select c_custkey, c_acctbal from merged",
    "replay_log": _live(_LOG),
    "replay_prefix": _live(f"{_LOG} where event_id <= 4999"),
    "replay_twice": _live(_LOG),
    "replay_routing": " union all ".join(
        f"select {i} as collection, count(*) as n, sum(seq)::bigint as sum_seq from ({_live(f'{_LOG} where event_id % 3 = {i}')})" for i in (0, 1)
    ),
    "replay_rollback": _live(f"{_LOG} where event_id // 5 not in (select event_id // 5 from events where event_type = 'signup')"),
    "index_rebuild": """select r_regionkey, string_agg(n_nationkey::varchar, ',' order by n_nationkey) as nations
        from region join nation on n_regionkey = r_regionkey group by 1""",
    "tuple_key_lww": """select * exclude (r) from (select *, row_number() over (partition by l_orderkey, l_linenumber
        order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc,
                 l_returnflag desc, l_linestatus desc, l_shipdate desc) as r from lineitem) where r = 1""",
    "key_encode_u32": """select c_custkey, printf('%02X%02X%02X%02X', c_custkey % 256, (c_custkey // 256) % 256,
        (c_custkey // 65536) % 256, (c_custkey // 16777216) % 256) as key_hex from customer""",
    "key_encode_tuple": """select distinct lang, source, printf('%02X', strlen(lang)) || repeat('00', 7) || hex(lang) || hex(source) as key_hex
        from documents""",
}
