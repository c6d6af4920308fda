"""Collections of a state and their types."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from types import FunctionType
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

from keelstate.errors import Invalid

#: Columns that the log adds to a collection's own.
SEQ, OP, KIND = "commit_seq", "op_idx", "op_kind"
RESERVED = {SEQ, OP, KIND}

_KEY_TYPES = (T.StringType, T.BinaryType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


_NAMED = {
    "string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType, "byte": T.ByteType, "tinyint": T.ByteType,
    "short": T.ShortType, "smallint": T.ShortType, "int": T.IntegerType, "integer": T.IntegerType, "long": T.LongType,
    "bigint": T.LongType, "float": T.FloatType, "double": T.DoubleType, "date": T.DateType, "timestamp": T.TimestampType,
    "timestamp_ntz": T.TimestampNTZType,
}


def _struct(schema: str | T.StructType) -> T.StructType:
    """A type from its text; plain columns need no session, which Spark's own parser does."""
    if isinstance(schema, T.StructType):
        return schema
    parts = [part.split() for part in schema.split(",")]
    if all(len(part) == 2 and part[1].lower() in _NAMED for part in parts):
        return T.StructType([T.StructField(name, _NAMED[kind.lower()]()) for name, kind in parts])
    return T.StructType.fromDDL(schema)


def _is_key(kind: T.DataType) -> bool:
    if isinstance(kind, T.DecimalType):
        return kind.scale == 0
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_is_key(f.dataType) for f in kind.fields)
    return isinstance(kind, _KEY_TYPES)


@dataclass(frozen=True)
class CollectionSpec:
    """A keyed collection: its number in the log, its name, key and value columns, and whether it has an order."""

    id: int
    name: str
    key: T.StructType
    value: T.StructType
    ordered: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", _struct(self.key))
        object.__setattr__(self, "value", _struct(self.value))
        if isinstance(self.id, bool) or not isinstance(self.id, int) or not 0 <= self.id <= 255:
            raise Invalid("collection", f"id must be 0 to 255, got {self.id!r}")
        if not self.name.isidentifier() or self.name.startswith("_"):
            raise Invalid("collection", f"name must be an identifier, got {self.name!r}")
        if not self.keys or not self.values:
            raise Invalid(self.name, "key and value need at least one column each")
        for f in self.key.fields:
            if not _is_key(f.dataType):
                raise Invalid(self.name, f"{f.dataType.simpleString()} can't be a key")
        columns = [*self.keys, *self.values]
        if len(set(columns)) < len(columns) or RESERVED & set(columns):
            raise Invalid(self.name, "columns must differ from each other and from the log's")

    @property
    def keys(self) -> list[str]:
        return self.key.fieldNames()

    @property
    def values(self) -> list[str]:
        return self.value.fieldNames()

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.values]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(f.name, f.dataType, False) for f in self.key), *self.value.fields])

    @property
    def log_schema(self) -> T.StructType:
        """A row of the log: a deletion has no value."""
        fields = [T.StructField(SEQ, T.LongType()), T.StructField(OP, T.LongType()), T.StructField(KIND, T.StringType())]
        return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in self.schema])

    def key_of(self, key: Any) -> tuple:
        """A key as a tuple; a key of one column may stand alone."""
        parts = key if isinstance(key, tuple) and not (len(self.keys) == 1 and len(key) != 1) else (key,)
        if len(parts) != len(self.keys) or any(part is None for part in parts):
            raise Invalid(self.name, f"key {key!r} doesn't fit {self.key.simpleString()}")
        for part, f in zip(parts, self.key.fields):
            _check(part, f.dataType, self.name)
        return tuple(parts)

    def value_of(self, value: Any) -> tuple:
        """A value as a tuple; a value of one column may stand alone."""
        if isinstance(value, Row):
            value = value.asDict()
        if isinstance(value, Mapping) and not (len(self.values) == 1 and set(value) != set(self.values)):
            if set(value) != set(self.values):
                raise Invalid(self.name, f"value has columns {sorted(value)}, not {sorted(self.values)}")
            return tuple(value[name] for name in self.values)
        parts = value if isinstance(value, (tuple, list)) and len(self.values) > 1 else (value,)
        if len(parts) != len(self.values):
            raise Invalid(self.name, f"value {value!r} doesn't fit {self.value.simpleString()}")
        return tuple(parts)


_BOUNDS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _check(part: Any, kind: T.DataType, name: str) -> None:
    bits = _BOUNDS.get(type(kind))
    wrong = (
        isinstance(kind, T.StringType) and not isinstance(part, str)
        or isinstance(kind, T.BinaryType) and not isinstance(part, (bytes, bytearray))
        or bits is not None and (isinstance(part, bool) or not isinstance(part, int) or not -(1 << bits) <= part < 1 << bits)
    )
    if wrong:
        raise Invalid(name, f"key {part!r} isn't a {kind.simpleString()}")


@dataclass(frozen=True)
class StateSchema:
    """The collections of a state, and its derived views: functions of the collections, rebuilt after each load."""

    collections: Sequence[CollectionSpec]
    derived: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.collections:
            raise Invalid("schema", "at least one collection is needed")
        for what in ("id", "name"):
            found = [getattr(spec, what) for spec in self.collections]
            for value in found:
                if found.count(value) > 1:
                    raise Invalid("schema", f"duplicate collection {what} {value!r}")
        if clash := {spec.name for spec in self.collections} & set(self.derived):
            raise Invalid("schema", f"derived views share names with collections: {sorted(clash)}")

    def __getitem__(self, name: str) -> CollectionSpec:
        for spec in self.collections:
            if spec.name == name:
                return spec
        raise Invalid("collection", f"no collection {name!r}")

    def routed(self, id: int) -> CollectionSpec | None:
        """The collection of a log number; None for an unknown one, whose operations are skipped."""
        return next((spec for spec in self.collections if spec.id == id), None)

    def described(self) -> list[dict]:
        return [
            {"id": s.id, "name": s.name, "key": s.key.simpleString(), "value": s.value.simpleString(), "ordered": s.ordered}
            for s in sorted(self.collections, key=lambda s: s.id)
        ]


def state(derived: Mapping[str, Callable] | None = None, **collections: tuple) -> StateSchema:
    """state(users=(0, "k string", "name string"), hits=(1, "k long", "n long", False))."""
    specs = [CollectionSpec(row[0], name, row[1], row[2], *row[3:]) for name, row in collections.items()]
    return StateSchema(specs, derived or {})


@dataclass(frozen=True)
class collection:  # noqa: N801  reads as a declaration
    """A collection in a class that derive() turns into a schema."""

    id: int
    key: str | T.StructType
    value: str | T.StructType
    ordered: bool = True


def derive(declared: type) -> StateSchema:
    """The schema of a class: its collection() attributes in their order, and its methods as derived views.

    Other attributes aren't part of the state.

        @derive
        class Todos:
            items = collection(0, "k string", "title string, done boolean")

            def open_items(state):
                return state["items"].filter("not done")
    """
    if not isinstance(declared, type):
        raise Invalid("schema", f"derive() takes a class, not {type(declared).__name__}")
    parts = {name: part for name, part in vars(declared).items() if not name.startswith("_")}
    specs = [CollectionSpec(c.id, name, c.key, c.value, c.ordered) for name, c in parts.items() if isinstance(c, collection)]
    return StateSchema(specs, {name: part for name, part in parts.items() if isinstance(part, FunctionType)})
