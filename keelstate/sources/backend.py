"""Where a store keeps its state."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from keelstate.schema import StateSchema
from keelstate.sources.files import files_of


class Backend(Protocol):
    """Persistence of whole states. load() gives {} for an empty one; save() must be all or nothing."""

    def load(self, spark: SparkSession, schema: StateSchema) -> Mapping[str, DataFrame]: ...

    def save(self, state: Mapping[str, DataFrame]) -> None: ...


class NullBackend:
    """Keeps nothing."""

    def load(self, spark: SparkSession, schema: StateSchema) -> Mapping[str, DataFrame]:
        return {}

    def save(self, state: Mapping[str, DataFrame]) -> None:
        pass


class FolderBackend:
    """Whole states as numbered folders of Parquet; a state exists once its mark does. The newest two are kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = files_of(spark, root)

    def _saved(self) -> list[str]:
        return sorted(name for name in self.files.names("") if name.endswith(".json"))

    def load(self, spark: SparkSession, schema: StateSchema) -> Mapping[str, DataFrame]:
        if not (saved := self._saved()):
            return {}
        parts = json.loads(self.files.read(saved[-1]))
        return {s.name: spark.read.schema(s.schema).parquet(self.files.uri(parts[s.name])) for s in schema.collections if s.name in parts}

    def save(self, state: Mapping[str, DataFrame]) -> None:
        saved, taken = self._saved(), self.files.names("")
        number = max((int(name.split(".")[0]) for name in taken), default=0) + 1
        parts = {}
        for name in state:
            parts[name] = f"{number:020d}/{name}"
            state[name].write.parquet(self.files.uri(parts[name]))
            self.files.sync(parts[name])
        self.files.publish(f"{number:020d}.json", json.dumps(parts).encode())
        for name in saved[:-1]:
            self.files.remove(name)
            self.files.remove(name.removesuffix(".json"))
