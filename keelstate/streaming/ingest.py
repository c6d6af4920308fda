"""Streams of operations: into a store, batch by batch, or folded as they come."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keelstate.operators.replay import DELETE, PUT, folded, latest
from keelstate.store import Store


def latest_state(stream: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "kind") -> DataFrame:
    """The live state of a stream of operations, for complete output: a partial aggregate per key."""
    return folded(stream, keys, order, kind)


def ingest(
    stream: DataFrame, store: Store, collection: str, order: Sequence[str], checkpoint: str, kind: str = "kind", **trigger
) -> StreamingQuery:
    """Write a stream of operations (key, value, order columns and kind) to a collection.

    A micro-batch is one transaction: of each key its newest operation. Its number is put down in
    the store's folder once its commit is published, and a batch that is run again is skipped if it
    stands there. After a crash between the two it is run again over its own commit, which changes
    nothing, as puts carry whole values.
    """
    spec = store.schema[collection]

    def one(batch: DataFrame, number: int) -> None:
        if number <= ingested(store, collection):
            return
        newest = latest(batch, spec.keys, [F.col(c).desc() for c in order]).persist()
        try:

            def body(tx) -> None:
                there = getattr(tx, collection)
                gone = newest.filter(F.col(kind) == DELETE).select(*spec.keys)
                puts = newest.filter(F.col(kind) == PUT).select(*spec.columns)
                if not gone.isEmpty():
                    there.delete_df(gone)
                if not puts.isEmpty():
                    there.put_df(puts)

            store.write_durable(body)
            if store.log is not None:
                path = _mark(collection, number)
                store.log.files.publish(path, json.dumps({"batch": number}).encode())
        finally:
            newest.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _mark(collection: str, number: int) -> str:
    return f"ingested/{collection}/{number:020d}.json"


def ingested(store: Store, collection: str) -> int:
    """The last batch of a stream that the store holds, or -1."""
    names = store.log.files.names(f"ingested/{collection}") if store.log is not None else []
    return max((int(name.split(".")[0]) for name in names), default=-1)
