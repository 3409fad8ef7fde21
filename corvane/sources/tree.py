"""Trees of files as data sources, for batches and streams.

``spark.read.format("document_tree").load(root)`` gives the rows of :func:`corvane.sources.files.scan_files`;
``spark.readStream.format("document_tree")`` gives each file once, in order of its time of change. A reader of another format
is a subclass with its own ``name``, ``schema`` and ``rows``: :class:`IssueFiles` reads JSON lines.

The driver lists the tree and plans partitions of about ``packBytes``, files in the order of their folded paths; tasks read, hash
and parse. The options ``prefix`` (of the path), ``suffixes`` (comma-separated), ``minBytes`` and ``maxBytes`` are applied to the listing, so files
that they rule out are not opened, by batches and streams alike. They are options, not pushed filters: Spark 4.1 keeps the plan of a
Python source's first pushed filter with the table, and a second query on the same DataFrame would read that plan's files. A
file is hashed in blocks; with ``keepBytes`` the content of a larger one is left out (null). Empty files are rows, too.

Streams remember the time and path of the last file that was listed. Files younger than ``settleSeconds`` wait
for a later batch, so a file that is still written, or another of the same instant, is not passed by. A restart goes on behind the
last committed file. A file that is moved in with an older time than one already read is not seen, as for Spark's own file streams.
"""

from __future__ import annotations

import hashlib
import json
import time
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

FILES = "path string, name string, suffix string, bytes long, checksum string, content binary"
BLOCK = 1 << 20


@dataclass(frozen=True)
class Found:
    """A listed file; ``path`` is relative to the root."""

    path: str
    bytes: int
    changed: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def suffix(self) -> str:
        name = self.name
        return "." + name.rsplit(".", 1)[-1].lower() if "." in name and not name.endswith(".") else ""

    @property
    def order(self) -> tuple[str, str]:
        return unicodedata.normalize("NFC", self.path).casefold(), self.path


@dataclass
class Pack(InputPartition):
    """Files that one task reads."""

    files: tuple[Found, ...]


class Changed(RuntimeError):
    """A file is not what it was when it was listed."""


def _open(root: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
    return files, path.rstrip("/")


def list_tree(root: str) -> list[Found]:
    """All files below ``root`` but those of the system, in order."""
    files, path = _open(root)
    found = [
        Found(i.path[len(path) :].lstrip("/"), i.size, i.mtime_ns or 0)
        for i in files.get_file_info(fs.FileSelector(path, recursive=True))
        if i.type == fs.FileType.File
    ]
    return sorted((f for f in found if f.name != ".DS_Store" and not f.name.startswith("._")), key=lambda f: f.order)


def read_file(root: str, found: Found, keep: int | None = None) -> tuple[str, bytes | None]:
    """Checksum and content; a size other than the listed one is an error."""
    files, path = _open(root)
    kept, total, digest = [], 0, hashlib.sha256()
    keeps = keep is None or found.bytes <= keep
    with files.open_input_stream(f"{path}/{found.path}") as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
            total += len(block)
            if keeps:
                kept.append(block)
    if total != found.bytes:
        raise Changed(f"{found.path} had {found.bytes} bytes when it was listed and has {total}")
    return digest.hexdigest(), b"".join(kept) if keeps else None


def _packs(files: list[Found], most: int) -> list[Pack]:
    packs: list[list[Found]] = []
    size = most + 1
    for f in files:
        if size + f.bytes > most and (not packs or packs[-1]):
            packs.append([])
            size = 0
        packs[-1].append(f)
        size += f.bytes
    return [Pack(tuple(p)) for p in packs]


class _Reads:
    def __init__(self, source: TreeSource) -> None:
        self.source = source
        self.root = source.options["path"]
        self.pack_bytes = int(source.options.get("packBytes", 64 << 20))
        self.prefix = source.options.get("prefix", "")
        self.suffixes = {x.strip().lower() for x in source.options.get("suffixes", "").split(",") if x.strip()}
        self.sizes = int(source.options.get("minBytes", 0)), int(source.options.get("maxBytes", 1 << 62))

    def listing(self) -> list[Found]:
        low, high = self.sizes
        return [
            f
            for f in list_tree(self.root)
            if f.path.startswith(self.prefix) and (not self.suffixes or f.suffix in self.suffixes) and low <= f.bytes <= high
        ]

    def read(self, partition: Pack) -> Iterator[tuple]:
        for found in partition.files:
            yield from self.source.rows(self.root, found)


class TreeReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Pack]:
        return _packs(self.listing(), self.pack_bytes) or [Pack(())]


class TreeStream(_Reads, DataSourceStreamReader):
    def __init__(self, source: TreeSource) -> None:
        super().__init__(source)
        self.settle = float(source.options.get("settleSeconds", 2))

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        last = max(((f.changed, f.path) for f in self.listing() if f.changed <= until), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        after, upto = ((o["changed"], o["path"]) for o in (start, end))
        return _packs([f for f in self.listing() if after < (f.changed, f.path) <= upto], self.pack_bytes)

    def commit(self, end: dict) -> None:
        """Offsets are all that is kept."""


class TreeSource(DataSource):
    """Files as rows."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self)

    def streamReader(self, schema: T.StructType) -> TreeStream:
        return TreeStream(self)

    def rows(self, root: str, found: Found) -> Iterator[tuple]:
        """The rows of one file."""
        keep = self.options.get("keepBytes")
        checksum, content = read_file(root, found, int(keep) if keep is not None else None)
        yield found.path, found.name, found.suffix, found.bytes, checksum, content


class IssueFiles(TreeSource):
    """External issues: JSON lines (title, url, published_at, publisher, summary) of ``.jsonl`` files, with the file and line they stand in. A line that
    is no such object is a row with its failure. Files of other kinds are passed by."""

    @classmethod
    def name(cls) -> str:
        return "issue_files"

    def schema(self) -> str:
        return "path string, line int, title string, url string, published_at timestamp, publisher string, summary string, failure string"

    def rows(self, root: str, found: Found) -> Iterator[tuple]:
        if found.suffix != ".jsonl":
            return
        _, content = read_file(root, found)
        for number, raw in enumerate(content.splitlines(), 1):
            if not raw.strip():
                continue
            failure, said, at = None, {}, None
            try:
                said = json.loads(raw.decode("utf-8"))
                at = said.get("published_at") and datetime.fromisoformat(said["published_at"])
            except UnicodeDecodeError:
                failure = "decode_error"
            except (json.JSONDecodeError, AttributeError):
                failure, said = "corrupt_structure", {}
            except (TypeError, ValueError):
                failure = "invalid_timestamp"
            text = [said.get(k) if isinstance(said.get(k), str) else None for k in ("title", "url", "publisher", "summary")]
            if failure is None and (text[0] is None or text[1] is None):
                failure = "missing_field"
            yield found.path, number, text[0], text[1], at, text[2], text[3], failure


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (TreeSource, IssueFiles):
        spark.dataSource.register(source)
