"""Sources of documents behind one contract: a Spark data source that lists and opens files, by type.

    register(spark)
    spark.read.format("glosswork").option("type", "LOCAL_FOLDER").option("path", "/library").load()

Rows: item_id, relative_path, file_name, extension, size, modified, etag, is_remote, content (read only with option "content"
set to "true"). A partition is a top-level folder of the library, so folders are listed side by side. Uploads are pushed, so
their listing is empty; remote listings are read from a dump (a folder of JSON pages), since the engine opens no connection.
Paths that leave the library, directly or by a link, are not followed.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = ("docx", "pdf", "xlsx", "txt")
MAX_DEPTH, MAX_BYTES = 12, 512 * 1024 * 1024
SCHEMA = "item_id string, relative_path string, file_name string, extension string, size bigint, modified timestamp, etag string, is_remote boolean, content binary"
TYPES = ("LOCAL_FOLDER", "NETWORK_SHARE", "REMOTE", "UPLOAD")


class UnsafePath(ValueError):
    """A path that leaves the folder it must stay in."""


def guarded(root: str, path: str) -> Path:
    """The file that `path` names inside `root`, resolved; errors say which of the checks failed: inside, there, a file, of a
    size from 1 byte to MAX_BYTES."""
    base = Path(root).resolve()
    found = (base / path).resolve()
    if base != found and base not in found.parents:
        raise UnsafePath("outside of the library")
    if not found.exists():
        raise FileNotFoundError(path)
    if not found.is_file():
        raise UnsafePath("not a regular file")
    if not 0 < found.stat().st_size <= MAX_BYTES:
        raise UnsafePath("empty or too large")
    return found


@dataclass
class Folder(InputPartition):
    path: str  # relative to the library; "" stands for the files directly in it


class FolderReader(DataSourceReader):
    def __init__(self, root: str, content: bool, max_depth: int):
        self.root, self.content, self.max_depth = root, content, max_depth

    def partitions(self) -> list[Folder]:
        with os.scandir(self.root) as entries:
            return [Folder(""), *(Folder(e.name) for e in entries if e.is_dir(follow_symlinks=False))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        start = os.path.join(self.root, partition.path) if partition.path else self.root
        for folder, inner, names in os.walk(start):  # links to folders are not followed
            depth = len(Path(folder).relative_to(self.root).parts)
            if depth >= self.max_depth or not partition.path:
                inner.clear()
            for name in names:
                ext = name.rpartition(".")[2].lower()
                if ext not in EXTENSIONS or name.startswith(("~$", ".~", "._")):
                    continue
                relative = os.path.relpath(os.path.join(folder, name), self.root).replace(os.sep, "/")
                try:
                    file = guarded(self.root, relative)
                except (ValueError, OSError):
                    continue
                stat = file.stat()
                when = dt.datetime.fromtimestamp(stat.st_mtime, dt.timezone.utc)
                yield (
                    hashlib.sha256(relative.lower().encode()).hexdigest(), relative, name, ext, stat.st_size, when, None, False,
                    file.read_bytes() if self.content else None,
                )


class DumpReader(DataSourceReader):
    """Files of remote pages {"value": [{"id", "path", "name", "size", "cTag", "eTag", "modified"}]}, a partition a page."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        return [Folder(n) for n in sorted(os.listdir(self.root)) if n.endswith(".json")]

    def read(self, partition: Folder) -> Iterator[tuple]:
        with open(os.path.join(self.root, partition.path), encoding="utf-8") as page:
            for v in json.load(page).get("value", []):
                name = v.get("name", "")
                when = dt.datetime.fromisoformat(v["modified"]) if v.get("modified") else None
                yield v.get("id"), v.get("path", name), name, name.rpartition(".")[2].lower(), v.get("size"), when, v.get("cTag") or v.get("eTag"), True, None


class NothingReader(DataSourceReader):
    def partitions(self) -> list[Folder]:
        return [Folder("")]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return iter(())


class Library(DataSource):
    """type: one of TYPES; path: the library's folder, or that of the dump."""

    @classmethod
    def name(cls) -> str:
        return "glosswork"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        kind = self.options.get("type", "LOCAL_FOLDER").upper()
        if kind not in TYPES:
            raise ValueError(f"unknown type of source: {kind}")
        if kind == "UPLOAD":
            return NothingReader()
        if kind == "REMOTE":
            return DumpReader(self.options["path"])
        return FolderReader(self.options["path"], self.options.get("content", "false") == "true", int(self.options.get("max_depth", MAX_DEPTH)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Library)


def reachable(kind: str, path: str | None) -> str | None:
    """Why a source cannot be read; null if it can. Uploads always can."""
    if kind.upper() == "UPLOAD":
        return None
    if not path or not Path(path).is_absolute():
        return "the path must be absolute"
    return None if os.path.isdir(path) and os.access(path, os.R_OK) else "the folder is not there or not readable"


def store_uploads(accepted: DataFrame, root: str) -> None:
    """Uploaded files (file_name, content) that passed the check, added to the table of uploads."""
    accepted.write.mode("append").parquet(f"{root}/uploads")
