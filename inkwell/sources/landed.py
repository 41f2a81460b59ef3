"""Landed dumps as a data source of their own: ``spark.read`` and ``spark.readStream`` with format ``landed_dumps``.

It gives one row (path, pos, raw) for each entry of the files below a folder, raw as JSON whatever the dump's form; ``dumps`` makes
items of them.  Files are partitions; a stream's offset is the time and name of the last file that it took."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from inkwell.sources.dumps import EmptyDump

#: A partition takes files until it has so many bytes; rows go out in batches of so many.
PARTITION_BYTES, BATCH = 32_000_000, 1000
_CONTENT, _ATOM = "{http://purl.org/rss/1.0/modules/content/}", "{http://www.w3.org/2005/Atom}"


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def board_entries(raw: bytes) -> Iterator:
    """The places of a board's list; what isn't an object keeps its place."""
    yield from json.loads(raw).get("data") or []


def note_entries(raw: bytes) -> Iterator:
    """Objects of a JSON array, or of lines."""
    text = raw.decode().lstrip("﻿ \t\r\n")
    rows = json.loads(text) if text.startswith("[") else (json.loads(line) for line in text.splitlines() if line.strip())
    yield from (r for r in rows if isinstance(r, dict))


def article_entries(raw: bytes) -> Iterator:
    """Answers of an article API: one, over as many lines as it likes, or one a line."""
    text = raw.decode()
    try:
        rows = [json.loads(text)]
    except json.JSONDecodeError:
        rows = (json.loads(line) for line in text.splitlines() if line.strip())
    yield from (r for r in rows if isinstance(r, dict))


def feed_entries(raw: bytes) -> Iterator:
    """Items of RSS with their fields, or entries of Atom, as the built-in XML reader would name them."""
    for node in ElementTree.fromstring(raw).iter():
        if node.tag == "item":
            out: dict = {"category": [c.text for c in node.findall("category") if c.text]}
            out |= {n.tag: n.text for n in node if n.tag in ("title", "link", "description", "author", "pubDate")}
            yield out | {"content:encoded": node.findtext(f"{_CONTENT}encoded")}
        elif node.tag == f"{_ATOM}entry":
            out = {k: node.findtext(_ATOM + k) for k in ("title", "id", "summary", "content", "published", "updated")}
            out["link"] = [{f"_{k}": n.get(k) for k in ("href", "rel")} for n in node.findall(f"{_ATOM}link")]
            out["author"] = {"name": node.findtext(f"{_ATOM}author/{_ATOM}name")}
            yield out | {"category": [{"_term": n.get("term")} for n in node.findall(f"{_ATOM}category")]}


ENTRIES = {"board": board_entries, "notes": note_entries, "article": article_entries, "feed": feed_entries}


class _Folder:
    """The files of a folder in order of time and name, and their entries."""

    def __init__(self, options: dict):
        self.path, self.entries, self.on_empty = options["path"], ENTRIES[options.get("dump", "board")], options.get("onempty", "fail")
        if self.on_empty not in ("fail", "keep"):
            raise ValueError("onEmpty is fail or keep")

    def files(self) -> list[tuple[int, str, int]]:
        """(time, path, bytes); files whose names begin with ``_`` or ``.`` aren't there yet, or aren't dumps."""
        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")

    def split(self, files: list[tuple[int, str, int]]) -> list[Files]:
        out, held, size = [], [], 0
        for _, path, n in files:
            if held and size + n > PARTITION_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(tuple(held))] if held else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows: list[tuple[str, int | None, str | None]] = []
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                own = [(path, i, json.dumps(e, ensure_ascii=False)) for i, e in enumerate(self.entries(f.read()))]
            if not own and self.on_empty == "fail":
                raise EmptyDump(path)
            rows += own or [(path, None, None)]
            while len(rows) >= BATCH:
                yield self._batch(rows[:BATCH])
                rows = rows[BATCH:]
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "pos", "raw"])


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self) -> list[Files]:
        files = self.folder.files()
        if not files and self.folder.on_empty == "fail":
            raise EmptyDump(self.folder.path)
        return self.folder.split(files) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class DumpStreamReader(DataSourceStreamReader):
    """Takes what has landed since the last offset.  A file must not be given a time or name before one that was taken."""

    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self.folder.files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["time"], o["path"])
        return self.folder.split([f for f in self.folder.files() if key(start) < f[:2] <= key(end)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        """Dumps stay where they are; a job may clear those behind its streams' offsets."""


class LandedDumps(DataSource):
    """Options: ``path``; ``dump``: board, feed, notes or article; ``onEmpty``: fail (a source that gave nothing has failed), or keep: a
    dump without entries is one row without place and entry, so that a ledger can count it as failed.

    Files are opened by Arrow's file systems (local and mounted folders, HDFS, object stores); for paths that only Spark can open,
    ``dumps.read_*`` read the same forms by Spark's own readers."""

    @classmethod
    def name(cls) -> str:
        return "landed_dumps"

    def schema(self) -> str:
        return "path string, pos int, raw string"

    def reader(self, schema) -> DumpReader:
        return DumpReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DumpStreamReader:
        return DumpStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LandedDumps)
    return spark
