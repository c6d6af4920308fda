"""The uncommitted delta of a collection as two tables, and its algebra over committed rows.

The puts and deletes of a transaction share no key. Both sides of every join are matched by key, so Spark
broadcasts a delta that it finds small and shuffles by key otherwise; no join is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 0 for committed rows, 1 for the overlay's own.
SRC = "src"
_GONE, _OURS, _HELD = "__gone", "__ours", "__held"


@dataclass(frozen=True)
class Overlay:
    """puts has key and value columns, deletes the key columns."""

    puts: DataFrame
    deletes: DataFrame
    keys: Sequence[str]

    def is_empty(self) -> bool:
        return self.puts.isEmpty() and self.deletes.isEmpty()


def _untouched(committed: DataFrame, overlay: Overlay) -> DataFrame:
    """Committed rows whose key the overlay neither puts nor deletes: one anti join."""
    touched = overlay.puts.select(*overlay.keys).unionByName(overlay.deletes.select(*overlay.keys))
    return committed.join(touched, list(overlay.keys), "left_anti")


def apply(committed: DataFrame, overlay: Overlay) -> DataFrame:
    """The state after the overlay is merged; also the values that a transaction sees."""
    return _untouched(committed, overlay).unionByName(overlay.puts.select(*committed.columns))


def iterate(committed: DataFrame, overlay: Overlay) -> DataFrame:
    """apply() with src, in whose order (then by key) a transaction iterates: changed keys come last."""
    kept = _untouched(committed, overlay).withColumn(SRC, F.lit(0))
    return kept.unionByName(overlay.puts.select(*committed.columns).withColumn(SRC, F.lit(1)))


def lookup(asked: DataFrame, committed: DataFrame, overlay: Overlay, value: Sequence[str]) -> DataFrame:
    """Each asked key with `present` and its value: deletes first, then puts, then committed rows.

    That order holds too where a delta that isn't a transaction's both deletes and puts a key.
    """
    keys = list(overlay.keys)
    gone = overlay.deletes.select(*keys, F.lit(True).alias(_GONE))
    ours = overlay.puts.select(*keys, F.lit(True).alias(_OURS), *(F.col(c).alias(f"__put_{c}") for c in value))
    theirs = committed.select(*keys, F.lit(True).alias(_HELD), *value)
    joined = asked.select(*keys).join(theirs, keys, "left").join(ours, keys, "left").join(gone, keys, "left")
    stays = F.col(_GONE).isNull()
    present = stays & F.coalesce(_OURS, _HELD, F.lit(False))
    picked = [F.when(stays & F.col(_OURS), F.col(f"__put_{c}")).when(stays, F.col(c)).alias(c) for c in value]
    return joined.select(*keys, present.alias("present"), *picked)


def existed(asked: DataFrame, committed: DataFrame, overlay: Overlay) -> DataFrame:
    """Whether a delete of each asked key meets a put of the overlay or a committed row."""
    keys = list(overlay.keys)
    puts = overlay.puts.select(*keys, F.lit(True).alias(_OURS))
    theirs = committed.select(*keys, F.lit(True).alias(_HELD))
    joined = asked.select(*keys).join(theirs, keys, "left").join(puts, keys, "left")
    return joined.select(*keys, F.coalesce(_OURS, _HELD, F.lit(False)).alias("existed"))


def retain(committed: DataFrame, overlay: Overlay, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, keys removed) of the merged view under a condition; a null condition removes."""
    merged = apply(committed, overlay)
    held = F.coalesce(keep, F.lit(False))
    return merged.filter(held), merged.filter(~held).select(*overlay.keys)


def put(overlay: Overlay, rows: DataFrame) -> Overlay:
    """The overlay after rows (unique by key) are put: they replace puts and undo deletes."""
    keys = list(overlay.keys)
    new = rows.select(*keys)
    return Overlay(
        overlay.puts.join(new, keys, "left_anti").unionByName(rows.select(*overlay.puts.columns)),
        overlay.deletes.join(new, keys, "left_anti"),
        overlay.keys,
    )


def delete(overlay: Overlay, committed: DataFrame, gone: DataFrame) -> Overlay:
    """The overlay after keys are deleted: puts of them go, and committed ones are marked."""
    keys = list(overlay.keys)
    marked = gone.select(*keys).distinct()
    held = marked.join(committed.select(*keys), keys, "left_semi")
    return Overlay(
        overlay.puts.join(marked, keys, "left_anti"),
        overlay.deletes.select(*keys).unionByName(held).distinct(),
        overlay.keys,
    )
