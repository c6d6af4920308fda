"""Errors of the engine, with fixed texts."""

from __future__ import annotations


class StoreError(Exception):
    """Any error of the engine."""


class IoError(StoreError):
    def __init__(self, cause: object):
        super().__init__(f"I/O error: {cause}")


class CodecError(StoreError):
    def __init__(self, cause: object):
        super().__init__(f"codec error: {cause}")


class NotFound(StoreError):
    def __init__(self, entity: str, id: object):
        super().__init__(f"{entity} not found: {id}")
        self.entity, self.id = entity, id


class AlreadyExists(StoreError):
    def __init__(self, entity: str, id: object):
        super().__init__(f"{entity} already exists: {id}")
        self.entity, self.id = entity, id


class Invalid(StoreError):
    def __init__(self, field: str, message: str):
        super().__init__(f"invalid {field}: {message}")
        self.field, self.message = field, message


class LogCorrupted(StoreError):
    """offset is the byte of a binary log, or the commit number of a table log."""

    def __init__(self, offset: int, reason: str):
        super().__init__(f"WAL corrupted at offset {offset}: {reason}")
        self.offset, self.reason = offset, reason


class SnapshotVersion(StoreError):
    def __init__(self, version: int, expected: int):
        super().__init__(f"snapshot version mismatch: got {version}, expected {expected}")
        self.version, self.expected = version, expected
