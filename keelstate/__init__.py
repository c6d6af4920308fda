"""Keyed-state engine on Spark: typed collections, transactions, an operation log and snapshots."""
