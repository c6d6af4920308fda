"""Folds of an operation log: the last writer of a key wins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstate.schema import StateSchema

PUT, DELETE = "put", "delete"


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row of each key; order lists columns from most to least significant, newest first.

    The rank filter lets Spark drop all but one row a key before the shuffle
    (WindowGroupLimit), so a hot key costs one row per map task.
    """
    rank = "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)


def live(log: DataFrame, keys: Sequence[str], order: Sequence[Column], kind: str = "kind") -> DataFrame:
    """The state that the log leaves: newest row of each key, deleted keys left out."""
    return latest(log, keys, order).filter(F.col(kind) == PUT).drop(kind)


def folded(log: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "kind") -> DataFrame:
    """live() as a partial aggregate: for streams, where ranks aren't allowed. order rises to the newest."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return log.groupBy(*keys).agg(newest).select(*keys, "__row.*").filter(F.col(kind) == PUT).drop(kind)


def prefix(log: DataFrame, seq: str, last: int) -> DataFrame:
    """The operations up to and with a number."""
    return log.filter(F.col(seq) <= last)


def routed(log: DataFrame, collection: str, schema: StateSchema) -> Mapping[str, DataFrame]:
    """The operations of each collection by number; unknown numbers are skipped."""
    return {spec.name: log.filter(F.col(collection) == spec.id) for spec in schema.collections}


def committed_only(log: DataFrame, tx: str, aborted: Column) -> DataFrame:
    """The log without the transactions in which any operation meets the condition.

    The aborting transactions are found first, so the log itself is filtered by an anti join and a
    long transaction's operations are never gathered.
    """
    bad = log.filter(aborted).select(F.col(tx).alias("__tx")).distinct()
    return log.join(bad, F.col(tx) == F.col("__tx"), "left_anti")


def onto(snapshot: DataFrame, suffix: DataFrame, keys: Sequence[str], order: Sequence[Column], kind: str = "kind") -> DataFrame:
    """A snapshot with the log after it: keys that the log touches come from the log."""
    newest = latest(suffix, keys, order)
    untouched = snapshot.join(newest.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(newest.filter(F.col(kind) == PUT).select(*snapshot.columns))


def converted(log: DataFrame, key: str, convert: Callable[[Column], Column]) -> DataFrame:
    """The log with its stored key decoded by an expression; a key that can't be decoded is an error."""
    return log.withColumn(key, convert(F.col(key)))


def checked_text(key: Column) -> Column:
    """Bytes as UTF-8 text; anything else is an error, in puts and deletes alike."""
    return F.when(key.isNull() | F.is_valid_utf8(key), key.cast("string")).otherwise(
        F.raise_error(F.lit("WAL corrupted at offset 0: invalid UTF-8 key"))
    )
