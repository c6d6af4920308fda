"""Stores: immutable versions of a state, all-or-nothing transactions, and durability.

A version holds, for each collection, a table and layers of single-row changes that the driver
keeps (bounded; they are folded into the table when there are too many). Readers keep the version
that they have; writers take turns. With a log, a transaction is on disk before it is seen
(immediate mode) or soon after (grouped mode).
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keelstate.errors import Invalid, IoError, NotFound, StoreError
from keelstate.operators import overlay as algebra
from keelstate.operators.overlay import Overlay
from keelstate.operators.replay import DELETE, PUT, latest
from keelstate.schema import KIND, OP, CollectionSpec, StateSchema
from keelstate.sources.backend import Backend, NullBackend
from keelstate.sources.log import THRESHOLD, Bulk, Rows, Segment, TableLog

R = TypeVar("R")
#: Changed rows that the driver holds at most of a collection, a transaction's operations or what waits
#: for a flush, and layers that it looks through.
HELD_ROWS, LAYERS = 100_000, 32
#: Bytes up to which a table, by Spark's estimate, is written by the driver if it has at most HELD_ROWS rows.
HELD_BYTES = 64 << 20
#: What is wrong with the keys of a table.
_NULL, _TWICE = "a key is null", "keys of a table repeat; name a column to order them by"


@dataclass(frozen=True)
class FlushPolicy:
    """Immediate (no interval): a write is durable on return. Grouped: at most `interval` seconds later."""

    interval: float | None = None

    @classmethod
    def immediate(cls) -> FlushPolicy:
        return cls()

    @classmethod
    def grouped(cls, interval: float) -> FlushPolicy:
        return cls(interval)


class Committed:
    """One collection of a version: a table unique by key, and layers of changes over it, oldest first.

    A loose one's table is still planned from what waits for the log; it is planned anew once that is there.
    """

    def __init__(
        self, spark: SparkSession, spec: CollectionSpec, base: DataFrame | None, layers: tuple[dict, ...] = (), loose: bool = False
    ):
        self.spark, self.spec, self.base, self.layers, self.loose = spark, spec, base, layers, loose

    def held(self) -> int:
        return sum(map(len, self.layers))

    def get(self, key: tuple) -> tuple | None:
        for layer in reversed(self.layers):
            if key in layer:
                return layer[key]
        if self.base is None:
            return None
        rows = self.base.filter(_equals(self.spec, key)).limit(1).collect()
        return tuple(rows[0][name] for name in self.spec.values) if rows else None

    def with_layer(self, changes: dict) -> Committed:
        layers = (*self.layers, changes)
        if len(layers) > LAYERS:
            merged: dict = {}
            for layer in layers:
                merged |= layer
            layers = (merged,)
        return Committed(self.spark, self.spec, self.base, layers, self.loose)

    def overlay(self) -> Overlay:
        changes: dict = {}
        for layer in self.layers:
            changes |= layer
        return overlay_of(self.spark, self.spec, changes)

    def df(self) -> DataFrame:
        base = self.base if self.base is not None else table_of(self.spark, self.spec, [])
        return algebra.apply(base, self.overlay()) if any(self.layers) else base


def _equals(spec: CollectionSpec, key: tuple) -> Column:
    condition = F.lit(True)
    for f, part in zip(spec.key.fields, key):
        condition = condition & (F.col(f.name) == F.lit(part).cast(f.dataType))
    return condition


def table_of(spark: SparkSession, spec: CollectionSpec, rows: list[tuple], keys_only: bool = False) -> DataFrame:
    """Rows (key and value parts in order) as a table."""
    names = spec.keys if keys_only else spec.columns
    schema = to_arrow_schema(spec.schema)
    columns = [pa.array([row[i] for row in rows], schema.field(name).type) for i, name in enumerate(names)]
    kinds = [f for f in spec.schema.fields if f.name in names]
    made = spark.createDataFrame(pa.table(columns, names=list(names)))
    return made.select(*(F.col(f.name).cast(f.dataType) for f in kinds))


def overlay_of(spark: SparkSession, spec: CollectionSpec, changes: Mapping[tuple, tuple | None]) -> Overlay:
    puts = table_of(spark, spec, [(*key, *value) for key, value in changes.items() if value is not None])
    deletes = table_of(spark, spec, [key for key, value in changes.items() if value is None], keys_only=True)
    return Overlay(puts, deletes, spec.keys)


class Version(Mapping):
    """A state at one commit number. Collections and derived views are its entries, as tables."""

    def __init__(self, schema: StateSchema, seq: int, collections: Mapping[str, Committed]):
        self.schema, self.seq, self.collections = schema, seq, collections

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.schema.derived:
            return self.schema.derived[name](self)
        if name not in self.collections:
            raise KeyError(name)
        return self.collections[name].df()

    def __iter__(self) -> Iterator[str]:
        return iter((*self.collections, *self.schema.derived))

    def __len__(self) -> int:
        return len(self.collections) + len(self.schema.derived)

    def _of(self, name: str) -> Committed:
        self.schema[name]
        return self.collections[name]

    def get(self, name: str, key: Any = None, default: Any = None) -> Any:
        """The value of a key as a tuple (or alone, if of one column), or the default."""
        committed = self._of(name)
        value = committed.get(committed.spec.key_of(key))
        return default if value is None else _plain(value)

    def at(self, name: str, key: Any) -> Any:
        """The value of a key that must exist."""
        committed = self._of(name)
        value = committed.get(committed.spec.key_of(key))
        if value is None:
            raise NotFound(name, key)
        return _plain(value)

    def has(self, name: str, key: Any) -> bool:
        committed = self._of(name)
        return committed.get(committed.spec.key_of(key)) is not None

    def contains(self, name: str, keys: DataFrame) -> DataFrame:
        """Each key of a table, with whether the collection holds it."""
        spec = self.schema[name]
        held = self[name].select(*spec.keys, F.lit(True).alias("__held"))
        return keys.select(*spec.keys).join(held, spec.keys, "left").select(*spec.keys, F.coalesce("__held", F.lit(False)).alias("present"))

    def count(self, name: str) -> int:
        return self[name].count()

    def is_empty(self, name: str) -> bool:
        return self[name].isEmpty()

    def iterate(self, name: str) -> DataFrame:
        """All rows, by key if the collection has an order."""
        spec = self.schema[name]
        return self[name].orderBy(*spec.keys) if spec.ordered else self[name]

    def register_views(self) -> None:
        """A temporary view of each collection and derived view, for SQL."""
        for name in self:
            self[name].createOrReplaceTempView(name)


def _plain(value: tuple) -> Any:
    return value[0] if len(value) == 1 else value


class Collection:
    """A collection inside a transaction: reads see the transaction's own writes."""

    def __init__(self, tx: Transaction, spec: CollectionSpec, committed: Committed):
        self.tx, self.spec, self.committed = tx, spec, committed
        #: Single-row changes since the last bulk operation, and the segments in order.
        self.changes: dict[tuple, tuple | None] = {}
        self.segments: list[Segment] = []
        self.bulk: DataFrame | None = None  # the merged view up to the last bulk operation

    # reads

    def _get(self, key: tuple) -> tuple | None:
        if key in self.changes:
            return self.changes[key]
        if self.bulk is not None:
            rows = self.bulk.filter(_equals(self.spec, key)).limit(1).collect()
            return tuple(rows[0][name] for name in self.spec.values) if rows else None
        return self.committed.get(key)

    def get(self, key: Any) -> Any:
        value = self._get(self.spec.key_of(key))
        return None if value is None else _plain(value)

    def __contains__(self, key: Any) -> bool:
        return self._get(self.spec.key_of(key)) is not None

    def _below(self) -> DataFrame:
        return self.bulk if self.bulk is not None else self.committed.df()

    def df(self) -> DataFrame:
        """The merged view."""
        if not self.changes:
            return self._below()
        return algebra.apply(self._below(), overlay_of(self.tx.spark, self.spec, self.changes))

    def values(self) -> DataFrame:
        return self.df().select(*self.spec.values)

    def iterate(self) -> DataFrame:
        """The merged view with src: untouched rows (0) by key, then this transaction's (1) by key.

        After a bulk operation its rows count as untouched.
        """
        below = self._below()
        found = algebra.iterate(below, overlay_of(self.tx.spark, self.spec, self.changes))
        return found.orderBy(algebra.SRC, *self.spec.keys) if self.spec.ordered else found

    def is_empty(self) -> bool:
        """Whether the transaction has changed nothing here."""
        return not self.segments

    # writes

    def _rows(self) -> Rows:
        if not self.segments or not isinstance(self.segments[-1], Rows):
            self.segments.append(Rows(self.spec.name, []))
        elif len(self.segments[-1].ops) >= HELD_ROWS:
            self._spill()
            self.segments.append(Rows(self.spec.name, []))
        return self.segments[-1]

    def _spill(self) -> None:
        """Bring the operations that the driver holds to disk, and read them from there on."""
        below = self._below()
        if self.tx.log is not None:
            stored = self.tx.log.store(self.tx.seq, self.segments[-1])
            rows = self.tx.spark.read.schema(self.spec.log_schema).parquet(self.tx.log.files.uri(stored.path))
            newest = latest(rows, self.spec.keys, [F.col(OP).desc()])
            self.segments[-1] = stored
            puts, gone = newest.filter(F.col(KIND) == PUT).select(*self.spec.columns), newest.filter(F.col(KIND) == DELETE).select(*self.spec.keys)
        else:
            held = overlay_of(self.tx.spark, self.spec, self.changes)
            self.segments[-1] = Rows(self.spec.name, [])
            puts, gone = held.puts.checkpoint(), held.deletes.checkpoint()
        self.bulk, self.changes = algebra.apply(below, Overlay(puts, gone, self.spec.keys)), {}

    def put(self, key: Any, value: Any) -> None:
        self.tx.check_open()
        key, value = self.spec.key_of(key), self.spec.value_of(value)
        self._rows().ops.append((self.tx.next_op(), key, value))
        self.changes[key] = value

    def delete(self, key: Any) -> bool:
        """Delete a key; whether the merged view held it. The operation is logged in either case."""
        self.tx.check_open()
        key = self.spec.key_of(key)
        existed = self._get(key) is not None
        self._rows().ops.append((self.tx.next_op(), key, None))
        self.changes[key] = None
        return existed

    def update(self, key: Any, change: Callable[[Any], Any]) -> bool:
        """Put change(value) if the key is there."""
        value = self.get(key)
        if value is None:
            return False
        self.put(key, change(value))
        return True

    def _stage(self, kind: str, rows: DataFrame, keyed: bool = False) -> Bulk:
        """The operation with its rows stored, so that they are made once and stay the same.

        keyed: their keys must be neither null nor repeated, which the job that stores them finds out.
        """
        self.tx.check_open()
        spec, bulk = self.spec, Bulk(self.spec.name, self.tx.next_op(), kind, rows)
        null = F.lit(False)
        for name in spec.keys:
            null = null | F.col(name).isNull()
        if (held := _held(rows)) is not None:
            if keyed:
                spec_keys = held.select(spec.keys)
                self._check(sum(c.null_count for c in spec_keys.columns), held.num_rows - spec_keys.group_by(spec.keys).aggregate([]).num_rows)
            if self.tx.log is not None:
                return self.tx.log.stage(self.tx.seq, bulk, held)
            bulk.rows = self.tx.spark.createDataFrame(held).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema)).checkpoint()
        elif self.tx.log is None:
            bulk.rows = rows.checkpoint()
            if keyed:
                found = bulk.rows.groupBy(*spec.keys).agg(F.count("*").alias("n"))
                self._check(*found.agg(F.coalesce(F.sum(null.cast("int")), F.lit(0)), F.coalesce(F.max("n"), F.lit(1)) - 1).first())
        elif keyed:
            # Rows are dealt and sorted by key once: bad keys end that job, and the files suit point reads.
            place = F.row_number().over(Window.partitionBy(*spec.keys).orderBy(*spec.keys))
            fine = F.when(null, F.raise_error(F.lit(_NULL))).when(F.col("__place") > 1, F.raise_error(F.lit(_TWICE))).otherwise(F.lit(True))
            bulk.rows = rows.repartition(*(F.col(k) for k in spec.keys)).withColumn("__place", place).filter(fine).select(*rows.columns)
            try:
                bulk = self.tx.log.stage(self.tx.seq, bulk)
            except Exception as error:
                self._check(_NULL in str(error), _TWICE in str(error))
                raise
        else:
            bulk = self.tx.log.stage(self.tx.seq, bulk)
        return bulk

    def _check(self, nulls: int, repeats: int) -> None:
        if nulls:
            raise Invalid(self.spec.name, _NULL)
        if repeats:
            raise Invalid(self.spec.name, _TWICE)

    def _apply(self, bulk: Bulk, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        below = self.df()
        self.segments.append(bulk)
        self.bulk, self.changes = merged(below, bulk.rows), {}

    def put_df(self, rows: DataFrame, order_by: str | None = None) -> None:
        """Put a table. Keys must be unique, unless order_by names a column whose greatest value wins.

        The table is made once, by the job that stores it and checks its keys.
        """
        spec = self.spec
        if order_by is not None:
            rest = [c for c in rows.columns if c not in spec.keys]
            rows = rows.groupBy(*spec.keys).agg(F.max_by(F.struct(*rest), F.col(order_by)).alias("__row")).select(*spec.keys, "__row.*")
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields))
        bulk = self._stage(PUT, rows, keyed=True)

        def merged(below: DataFrame, new: DataFrame) -> DataFrame:
            return below.join(new.select(*spec.keys), spec.keys, "left_anti").unionByName(new)

        self._apply(bulk, merged)

    def delete_df(self, keys: DataFrame) -> DataFrame:
        """Delete a table of keys; gives each key with whether the merged view held it."""
        spec = self.spec
        gone = keys.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.key.fields)).distinct()
        bulk = self._stage(DELETE, gone)
        held = self.df().select(*spec.keys, F.lit(True).alias("__held"))
        existed = bulk.rows.join(held, spec.keys, "left").select(*spec.keys, F.coalesce("__held", F.lit(False)).alias("existed"))
        self._apply(bulk, lambda below, new: below.join(new, spec.keys, "left_anti"))
        return existed

    def retain(self, keep: Column) -> DataFrame:
        """Delete the rows that don't meet a condition; gives their keys. The deletions are logged."""
        removed = self.df().filter(~F.coalesce(keep, F.lit(False))).select(*self.spec.keys)
        self.delete_df(removed)
        return self.segments[-1].rows


def _held(rows: DataFrame) -> pa.Table | None:
    """A table that is small by Spark's estimate and by its rows, as the driver holds it; else None."""
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > HELD_BYTES:
        return None
    found = rows.limit(HELD_ROWS + 1).toArrow()
    return found if found.num_rows <= HELD_ROWS else None


class Transaction:
    """One attribute for each collection."""

    def __init__(self, spark: SparkSession, version: Version, log: TableLog | None = None):
        self.spark, self.version, self.log, self._op, self._open = spark, version, log, 0, True
        self.seq = version.seq + 1
        self._collections = {spec.name: Collection(self, spec, version.collections[spec.name]) for spec in version.schema.collections}

    def __getattr__(self, name: str) -> Collection:
        try:
            return self.__dict__["_collections"][name]
        except KeyError:
            raise AttributeError(name) from None

    def next_op(self) -> int:
        self._op += 1
        return self._op

    def check_open(self) -> None:
        if not self._open:
            raise Invalid("transaction", "it has ended")

    def finish(self) -> list[Segment]:
        """The operations, collection by collection in the order in which they are declared."""
        self._open = False
        return [segment for c in self._collections.values() for segment in c.segments]

    def merged(self, seq: int, settled: Callable[[str, DataFrame], DataFrame] | None) -> Version:
        """The version after this transaction; settled() makes a bulk view's plan stand on stored rows."""
        found = {}
        for name, c in self._collections.items():
            committed = c.committed
            if c.bulk is not None:
                committed = self._settled(name, c.spec, c.df(), settled)
            elif c.changes:
                committed = committed.with_layer(c.changes)
                if committed.held() > HELD_ROWS:
                    committed = self._settled(name, c.spec, committed.df(), settled)
            found[name] = committed
        return Version(self.version.schema, seq, found)

    def _settled(self, name: str, spec: CollectionSpec, rows: DataFrame, settled: Callable | None) -> Committed:
        return Committed(self.spark, spec, settled(name, rows) if settled else rows, loose=settled is None)


class Store:
    """A state of typed collections. Use it as a context manager, or close() it."""

    def __init__(
        self,
        spark: SparkSession,
        schema: StateSchema,
        backend: Backend | None = None,
        log: TableLog | None = None,
        snapshot_threshold: int = THRESHOLD,
    ):
        self.spark, self.schema, self.log, self.snapshot_threshold = spark, schema, log, snapshot_threshold
        self._backend = backend or NullBackend()
        rows = log.state() if log else self._backend.load(spark, schema)
        seq = log.next_seq - 1 if log else 0
        self._version = Version(schema, seq, {s.name: Committed(spark, s, rows.get(s.name)) for s in schema.collections})
        self._gate = threading.RLock()
        self._writer: int | None = None
        self._closed = False
        self._policy = FlushPolicy()
        self._pending: list[tuple[int, list[Segment]]] = []
        self._dirty = False
        self._error: BaseException | None = None
        self._wake = threading.Condition()
        self._written = self._flushed = 0
        self._stop = self._asked = False
        self._flusher: threading.Thread | None = None

    @classmethod
    def memory(cls, spark: SparkSession, schema: StateSchema) -> Store:
        """A store that keeps nothing on disk."""
        return cls(spark, schema)

    @classmethod
    def open(cls, spark: SparkSession, schema: StateSchema, path: str, snapshot_threshold: int = THRESHOLD, codec: str = "zstd") -> Store:
        """A store with a log in a folder: its newest snapshot and the valid commits after it."""
        return cls(spark, schema, log=TableLog(spark, path, schema, codec), snapshot_threshold=snapshot_threshold)

    @classmethod
    def with_backend(cls, spark: SparkSession, schema: StateSchema, backend: Backend) -> Store:
        """A store whose every write saves the whole state to a backend."""
        return cls(spark, schema, backend=backend)

    @property
    def backend(self) -> Backend | TableLog:
        return self.log or self._backend

    def read(self) -> Version:
        """The current version. It never changes, and doesn't hold up writers."""
        return self._version

    # writes

    def write(self, body: Callable[[Transaction], R]) -> R:
        """Run a transaction: all of it or, if body raises, nothing. Durable by the flush policy."""
        return self._write(body, durable=False)

    def write_durable(self, body: Callable[[Transaction], R]) -> R:
        """Run a transaction that is on disk on return, with all that waited before it."""
        return self._write(body, durable=True)

    def _write(self, body: Callable[[Transaction], R], durable: bool) -> R:
        me = threading.get_ident()
        if self._writer == me:
            raise Invalid("transaction", "a write inside a write")
        with self._gate:
            if self._closed:
                raise Invalid("store", "it is closed")
            if self._policy.interval is not None and not durable and (error := self.flush_error()):
                raise error
            self._writer = me
            try:
                tx = Transaction(self.spark, self._version, self.log)
                result = body(tx)
                self._commit(tx, durable)
                return result
            finally:
                self._writer = None

    def _commit(self, tx: Transaction, durable: bool) -> None:
        segments = tx.finish()
        if not segments:
            if durable:
                self._drain()
            return
        seq = tx.seq
        grouped = self._policy.interval is not None
        if self.log is None:
            version = tx.merged(seq, lambda name, rows: rows.checkpoint())
            if not grouped or durable:
                self._backend.save(version)  # before it is seen: a failed save changes nothing
            self._version = version
            self._mark(saved=not grouped or durable)
            return
        if grouped and not durable:
            self._version = tx.merged(seq, None)
            self._pending.append((seq, segments))
            self._mark(saved=False)
            if sum(len(s.ops) for _, held in self._pending for s in held if isinstance(s, Rows)) > HELD_ROWS:
                self._drain()  # sooner than due, as the driver holds enough
            return
        self._append([*self._pending, (seq, segments)])
        self._pending = []
        self._version = tx.merged(seq, lambda name, rows: self.log.state()[name])
        self._tighten()
        self._mark(saved=True)
        self._compact_if_due()

    def _append(self, waiting: list[tuple[int, list[Segment]]]) -> None:
        """One commit of some transactions, in their order; on any failure none of them is in the log."""
        try:
            for seq, segments in waiting:
                self.log.save_ops(seq, segments)
            self.log.sync()
        except BaseException:
            self.log.discard()
            raise

    def _mark(self, saved: bool) -> None:
        with self._wake:
            self._written += 1
            if saved:
                self._flushed = self._written
            self._dirty = not saved
            self._wake.notify_all()

    # snapshots

    def compact(self) -> None:
        """Store the current version as a snapshot; commits up to it are no longer needed."""
        if self.log is None:
            return
        with self._gate:
            self._drain()
            version = self._version
            self.log.write_snapshot(version.seq, {name: c.df() for name, c in version.collections.items()})
            rows = self.log.state()
            self._version = Version(self.schema, version.seq, {s.name: Committed(self.spark, s, rows[s.name]) for s in self.schema.collections})

    def _compact_if_due(self) -> None:
        if self.log is not None and self.log.count >= self.snapshot_threshold:
            self.compact()

    # grouped durability

    def set_flush_policy(self, policy: FlushPolicy) -> None:
        """Stop the present mode with a last flush, and start another."""
        self._end_flusher()
        with self._gate:
            self._drain()  # what was written since the flusher's last round
            self._policy = policy
        if policy.interval is not None:
            self._stop = False
            self._flusher = threading.Thread(target=self._flush_loop, name="keelstate-flusher", daemon=True)
            self._flusher.start()

    def _drain(self) -> None:
        """Under the gate: bring what waits to disk. What fails to get there waits on."""
        target = self._written
        if self.log is not None and self._pending:
            self._append(self._pending)
            self._pending = []
            self._tighten()
        elif self.log is None and self._dirty:
            self._backend.save(self._version)
        with self._wake:
            self._flushed = max(self._flushed, target)
            self._dirty = self._dirty and self._flushed < self._written
            self._wake.notify_all()

    def _tighten(self) -> None:
        """Plan the loose collections from the log, which now holds all that they stand on."""
        held = self._version.collections
        if any(c.loose for c in held.values()):
            rows = self.log.state()
            new = {name: Committed(self.spark, c.spec, rows[name]) if c.loose else c for name, c in held.items()}
            self._version = Version(self.schema, self._version.seq, new)

    def _flush_loop(self) -> None:
        while True:
            with self._wake:
                self._wake.wait_for(lambda: self._stop or self._asked, self._policy.interval)
                self._asked = False
                stop, due = self._stop, self._flushed < self._written
            if due:
                try:
                    with self._gate:
                        self._drain()
                        self._compact_if_due()
                except BaseException as error:  # told to the next writer or flush
                    with self._wake:
                        self._error = error if isinstance(error, StoreError) else IoError(error)
                        self._wake.notify_all()
            if stop:
                return

    def flush(self, timeout: float = 5.0) -> None:
        """Wait until all that is written now is on disk."""
        if self._policy.interval is None:
            return
        with self._wake:
            target = self._written
            self._asked = True
            self._wake.notify_all()
            done = self._wake.wait_for(lambda: self._flushed >= target or self._error is not None, timeout)
        if error := self.flush_error():
            raise error
        if not done:
            raise IoError("flush timed out waiting for the flusher")

    def flush_error(self) -> BaseException | None:
        """The last error of the flusher, once."""
        with self._wake:
            error, self._error = self._error, None
        return error

    def _end_flusher(self) -> None:
        if self._flusher is None:
            return
        with self._wake:
            self._stop = True
            self._wake.notify_all()
        self._flusher.join()
        self._flusher = None

    def close(self) -> None:
        """A last flush; later writes raise, and so does this if that flush failed.

        It waits for the writer at work, and no write is accepted after it, so none can miss the last flush.
        """
        with self._gate:
            if self._closed:
                return
            self._closed = True
        self._end_flusher()
        if not self._error:
            with self._gate:
                self._drain()
        if error := self.flush_error():
            raise error

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()
