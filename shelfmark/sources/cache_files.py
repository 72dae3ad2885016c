"""A folder of cached pages as a data source: ``spark.read.format("page_cache")``, and as a stream.

An entry is two files, ``<key>.body`` and ``<key>.json``, in a folder named by the first
two letters of the key.  The body is moved into place before its metadata, so that an
entry that can be seen is whole.  One partition reads one such folder; a filter on the
key reads those entries alone.  Folders may be on any store that Arrow reaches.

An entry whose metadata can't be read, whose body is gone, or whose body has another
hash, is a row with ``error`` and without a body.  The stream gives every entry once, and
again when it was replaced, in order of time written.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "cache_key string, url string, status_code int, content_type string, fetched_at timestamp, content_hash string, body string, error string"
_META = ("url", "status_code", "content_type", "fetched_at", "content_hash")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path) if not path.startswith("file:") else fs.FileSystem.from_uri("file://" + path[5:])


def _entries(path: str, folder: str = "") -> list[fs.FileInfo]:
    """The metadata files of a folder."""
    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root, recursive=not folder, allow_not_found=True))
    return [f for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith(".")]


def _text(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as stream:
        return stream.read()


def _row(path: str, key: str) -> tuple:
    """An entry's row."""
    store, root = _open(path)
    at = f"{root}/{key[:2]}/{key}"
    try:
        meta = json.loads(_text(store, f"{at}.json"))
        url, status, kind, fetched, wanted = (meta.get(c) for c in _META)
        when = datetime.fromisoformat(fetched) if fetched else None
        if not isinstance(url, str) or not isinstance(status, (int, type(None))):
            raise ValueError("metadata without a url or with a status that is no number")
    except (OSError, ValueError, TypeError, AttributeError) as error:
        return key, None, None, None, None, None, None, f"metadata: {error}"
    try:
        body = _text(store, f"{at}.body")
    except OSError:
        return key, url, status, kind, when, wanted, None, "body: not there"
    if hashlib.sha256(body).hexdigest() != wanted:
        return key, url, status, kind, when, wanted, None, "body: another hash"
    return key, url, status, kind, when, wanted, body.decode(errors="replace"), None


@dataclass
class _Keys(InputPartition):
    """One folder, or some entries of it."""

    folder: str
    keys: tuple[str, ...] | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on the key are read as such; all are left to Spark as well."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("cache_key",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.only is not None:
            by: dict[str, list[str]] = defaultdict(list)
            for key in sorted(k for k in self.only if isinstance(k, str) and k):
                by[key[:2]].append(key)
            return [_Keys(folder, tuple(keys)) for folder, keys in by.items()] or [_Keys("", ())]
        store, root = _open(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [_Keys(f.base_name) for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.Directory] or [_Keys("", ())]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        there = {f.base_name[:-5] for f in _entries(self.path, partition.folder)} if partition.keys != () else set()
        for key in sorted(there if partition.keys is None else there & set(partition.keys)):
            yield _row(self.path, key)


class _Stream(DataSourceStreamReader):
    """Offsets are (time written in nanoseconds, key) of the last entry given."""

    def __init__(self, path: str):
        self.path = path

    def _written(self) -> list[tuple[int, str]]:
        return sorted((f.mtime_ns or 0, f.base_name[:-5]) for f in _entries(self.path))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ns": -1, "key": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self._written()
        return {"ns": found[-1][0], "key": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((x["ns"], x["key"]) for x in (start, end))
        by: dict[str, list[str]] = defaultdict(list)
        for at in self._written():
            if low < at <= high:
                by[at[1][:2]].append(at[1])
        return [_Keys(folder, tuple(keys)) for folder, keys in by.items()]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        for key in partition.keys or ():
            yield _row(self.path, key)

    def commit(self, end: dict) -> None:
        pass


class PageCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PageCache)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def store(pages: DataFrame, path: str) -> None:
    """Write pages (cache_key, url, status_code, content_type, fetched_at, body); only those of a 2xx or 3xx status."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        for batch in batches:
            for r in batch.to_pylist():
                body = (r["body"] or "").encode()
                meta = {"url": r["url"], "status_code": r["status_code"], "content_type": r["content_type"], "fetched_at": r["fetched_at"].astimezone(UTC).isoformat() if r["fetched_at"] else None, "content_hash": hashlib.sha256(body).hexdigest()}
                at, draft = f"{root}/{r['cache_key'][:2]}", f".{r['cache_key']}.{hashlib.sha256(body).hexdigest()[:12]}"
                files.create_dir(at, recursive=True)
                for end, data in (("body", body), ("json", json.dumps(meta).encode())):
                    with files.open_output_stream(f"{at}/{draft}.{end}") as out:
                        out.write(data)
                    files.move(f"{at}/{draft}.{end}", f"{at}/{r['cache_key']}.{end}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    good = pages.select("cache_key", "url", "status_code", "content_type", "fetched_at", "body").filter("status_code BETWEEN 200 AND 399 AND cache_key IS NOT NULL")
    good.mapInArrow(run, "n long").agg({"n": "sum"}).collect()
