"""Small files of the store: published whole or not at all, in a local folder or a Hadoop file system."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession

from keelstate.errors import IoError


class Files(Protocol):
    """What the log needs of a file system. Paths are relative to the store's folder."""

    root: str

    def read(self, path: str) -> bytes: ...

    def publish(self, path: str, content: bytes) -> None:
        """Make a file that didn't exist appear with all its content; durable on return."""

    def names(self, path: str) -> list[str]: ...

    def sizes(self, path: str) -> dict[str, int]:
        """Bytes of the data files of a folder."""

    def sync(self, path: str) -> None:
        """Make the data files of a folder durable, where their writer's close doesn't."""

    def move(self, path: str, to: str) -> None: ...

    def remove(self, path: str) -> None: ...

    def uri(self, path: str) -> str: ...


def _is_data(name: str) -> bool:
    return name.endswith(".parquet") and not name.startswith((".", "_"))


class LocalFiles:
    """A folder that the driver and all executors see, such as a mount; POSIX rename and link rules."""

    def __init__(self, root: str):
        self.path = Path(root.removeprefix("file:").replace("//", "/", 1) if root.startswith("file:") else root)
        self.path.mkdir(parents=True, exist_ok=True)
        self.root = str(self.path)

    def read(self, path: str) -> bytes:
        try:
            return (self.path / path).read_bytes()
        except OSError as error:
            raise IoError(error) from error

    def publish(self, path: str, content: bytes) -> None:
        target = self.path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=target.parent, prefix=".tmp-")
        try:
            with os.fdopen(handle, "wb") as out:
                out.write(content)
                out.flush()
                os.fsync(out.fileno())
            os.link(name, target)  # fails if the target exists
            self._sync(target.parent)
        except OSError as error:
            raise IoError(error) from error
        finally:
            os.unlink(name)

    def names(self, path: str) -> list[str]:
        folder = self.path / path
        return sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) if folder.is_dir() else []

    def sizes(self, path: str) -> dict[str, int]:
        folder = self.path / path
        return {p.name: p.stat().st_size for p in folder.iterdir() if _is_data(p.name)} if folder.is_dir() else {}

    def sync(self, path: str) -> None:
        folder = self.path / path
        try:
            for name in self.sizes(path):
                self._sync(folder / name)
            while folder != self.path:  # a file is as durable as the folders above it
                self._sync(folder)
                folder = folder.parent
        except OSError as error:
            raise IoError(error) from error

    @staticmethod
    def _sync(path: Path) -> None:
        handle = os.open(path, os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)

    def move(self, path: str, to: str) -> None:
        target = self.path / to
        target.parent.mkdir(parents=True, exist_ok=True)
        os.replace(self.path / path, target)

    def remove(self, path: str) -> None:
        target = self.path / path
        if target.is_dir():
            shutil.rmtree(target, ignore_errors=True)
        else:
            target.unlink(missing_ok=True)

    def uri(self, path: str) -> str:
        return f"file://{self.path / path}"


class HadoopFiles:
    """A folder of any file system that Spark reads. A rename there doesn't replace an existing file."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def read(self, path: str) -> bytes:
        try:
            stream = self.fs.open(self._path(path))
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        except Exception as error:
            raise IoError(error) from error

    def publish(self, path: str, content: bytes) -> None:
        target, part = self._path(path), self._path(f"{path}.tmp")
        try:
            stream = self.fs.create(part, True)
            stream.write(bytearray(content))
            stream.hsync()
            stream.close()
            if self.fs.exists(target) or not self.fs.rename(part, target):
                raise IoError(f"{path} exists")
        except IoError:
            raise
        except Exception as error:
            raise IoError(error) from error

    def names(self, path: str) -> list[str]:
        folder = self._path(path)
        if not self.fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder) if not s.getPath().getName().endswith(".tmp"))

    def sizes(self, path: str) -> dict[str, int]:
        folder = self._path(path)
        if not self.fs.exists(folder):
            return {}
        found = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(folder)}
        return {name: size for name, size in found.items() if _is_data(name)}

    def sync(self, path: str) -> None:
        """Nothing to do: such a file system has a file's bytes once its writer has closed it."""

    def move(self, path: str, to: str) -> None:
        target = self._path(to)
        self.fs.mkdirs(target.getParent())
        self.fs.rename(self._path(path), target)

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def uri(self, path: str) -> str:
        return f"{self.root}/{path}"


def files_of(spark: SparkSession, root: str) -> Files:
    return HadoopFiles(spark, root) if "://" in root and not root.startswith("file:") else LocalFiles(root)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only in a single process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise IoError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="keelstate-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
