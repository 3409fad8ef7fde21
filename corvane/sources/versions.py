"""Folders whose content changes as a whole: numbered versions, and numbered pointers that are written once.

A version is a folder of its own that no reader knows until a pointer names it. Pointers are numbered; number n + 1 can be made
once, by a rename that fails if it is there, so of two writers that saw the same state one loses and is told. Readers follow
the highest pointer and never see a half-written or deleted table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

POINTERS = "_versions"


class Conflict(RuntimeError):
    """Another writer published first."""


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of its own."""
    target, files = _path(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str, max_bytes: int = 1 << 20) -> str:
    """A small file; a larger one is refused before it is read."""
    target, files = _path(spark, path)
    size = files.getFileStatus(target).getLen()
    if size > max_bytes:
        raise ValueError(f"{path} has {size} bytes; the limit is {max_bytes}")
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0][0]).decode()


def names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files right below ``path``; none if there is no such folder."""
    target, files = _path(spark, path)
    if not files.exists(target):
        return []
    return sorted((s.getPath().getName(), s.getLen()) for s in files.listStatus(target) if s.isFile())


def _rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename, unless the target is there."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(old, new, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    about: dict


class Versions:
    """The versions of the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> Version | None:
        found = [n for n, _ in names(self.spark, f"{self.root}/{POINTERS}") if n.isdigit()]
        if not found:
            return None
        said = json.loads(read_text(self.spark, f"{self.root}/{POINTERS}/{max(found)}"))
        return Version(int(max(found)), f"{self.root}/{said['folder']}", said["about"])

    def fresh(self) -> str:
        """A folder for the next version."""
        return f"{self.root}/v-{uuid.uuid4().hex}"

    def publish(self, path: str, seen: Version | None, **about) -> Version:
        """Make ``path`` the current version if it still is the one that was ``seen``."""
        if not path.startswith(self.root + "/"):
            raise ValueError(f"{path} does not lie in {self.root}")
        number = seen.number + 1 if seen else 1
        staged = f"{self.root}/{POINTERS}/.{uuid.uuid4().hex}"
        write_text(self.spark, staged, json.dumps({"folder": path[len(self.root) + 1 :], "about": about}, sort_keys=True))
        if not _rename_new(self.spark, staged, f"{self.root}/{POINTERS}/{number:012d}"):
            target, files = _path(self.spark, staged)
            files.delete(target, False)
            raise Conflict(f"version {number} of {self.root} is there already")
        return Version(number, path, about)
