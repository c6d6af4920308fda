"""A store for asyncio: writes and flushes run in threads, reads are immediate."""

from __future__ import annotations

import asyncio
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from keelstate.schema import StateSchema
from keelstate.store import Store, Transaction, Version

R = TypeVar("R")


class AsyncStore:
    """A handle on a store; copies share it."""

    def __init__(self, store: Store):
        self.store = store

    @classmethod
    async def open(cls, spark: SparkSession, schema: StateSchema, path: str, **options) -> AsyncStore:
        return cls(await asyncio.to_thread(Store.open, spark, schema, path, **options))

    def clone(self) -> AsyncStore:
        return AsyncStore(self.store)

    def read(self) -> Version:
        return self.store.read()

    async def write(self, body: Callable[[Transaction], R]) -> R:
        return await asyncio.to_thread(self.store.write, body)

    async def write_durable(self, body: Callable[[Transaction], R]) -> R:
        return await asyncio.to_thread(self.store.write_durable, body)

    async def flush(self) -> None:
        await asyncio.to_thread(self.store.flush)

    async def close(self) -> None:
        await asyncio.to_thread(self.store.close)
