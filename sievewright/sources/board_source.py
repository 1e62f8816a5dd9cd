"""Boards as a Python data source: a reader that asks page by page, batch and streaming, and a store that keeps each content once."""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "tenant string, page int, sha256 string, body binary"
STORED = "sha256 string, body binary"
#: Pages of a board that are asked for at most, and pages of one partition.
PAGES, PER_TASK = 100, 10


def _transport(options: dict) -> Callable[[str, int], bytes | None]:
    """The function ``(tenant, page) -> body or None`` that option ``transport`` names as ``module:function``; ``path`` is bound first if it is given."""
    module, _, name = options["transport"].partition(":")
    found = getattr(importlib.import_module(module), name)
    return (lambda tenant, page: found(options["path"], tenant, page)) if "path" in options else found


@dataclass
class Pages(InputPartition):
    tenant: str
    first: int
    last: int


def _rows(fetch: Callable, part: Pages) -> Iterator[tuple]:
    for page in range(part.first, part.last):
        body = fetch(part.tenant, page)
        if body is None:
            return
        yield part.tenant, page, hashlib.sha256(body).hexdigest(), body


class BoardReader(DataSourceReader):
    """One partition for each tenant and ten pages: a long board is asked for by many tasks; a page that is not there ends a partition."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        pages, step = int(self.options.get("pages", PAGES)), int(self.options.get("pages_per_task", PER_TASK))
        return [Pages(tenant, k, min(k + step, pages)) for tenant in self.options["tenants"].split(",") if tenant for k in range(0, pages, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from _rows(_transport(self.options), partition)


class BoardStreamReader(DataSourceStreamReader):
    """Offsets are the next page of each tenant: a batch holds the pages that came since, at most ten a tenant."""

    def __init__(self, options: dict):
        self.options, self.known = options, None

    def _tenants(self) -> list[str]:
        return [t for t in self.options["tenants"].split(",") if t]

    def initialOffset(self) -> dict:
        return {t: 0 for t in self._tenants()}

    def latestOffset(self) -> dict:
        fetch, step = _transport(self.options), int(self.options.get("pages_per_task", PER_TASK))
        found = dict(self.known or self.initialOffset())
        for tenant, page in found.items():
            while page < found[tenant] + step and page < int(self.options.get("pages", PAGES)) and fetch(tenant, page) is not None:
                page += 1
            found[tenant] = page
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = dict(end)
        return [Pages(t, start.get(t, 0), last) for t, last in end.items() if last > start.get(t, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from _rows(_transport(self.options), partition)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    rows: int


class ContentWriter(DataSourceArrowWriter):
    """Bodies by their hash below ``path``, a folder that all machines share: ``ab/cdef...``.

    Tasks write into folders of their own, files named by their hash, and tell the driver no more than the folder; the commit moves what is not there yet and writes a record of the write; an abort drops it. A task that is run again, a body that
    comes twice, and a write that is repeated add nothing. A body that does not have the hash it comes with fails the write.
    """

    def __init__(self, options: dict):
        self.path, self.write_id = options["path"].removeprefix("file://"), uuid.uuid4().hex
        self.staging = f"{self.path}/_staging/{self.write_id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        folder, rows = uuid.uuid4().hex, 0
        os.makedirs(f"{self.staging}/{folder}", exist_ok=True)
        for batch in iterator:
            for given, body in zip(batch.column("sha256"), batch.column("body")):
                given, body = given.as_py(), body.as_py()
                rows += 1
                digest = hashlib.sha256(body).hexdigest()
                if given is not None and given != digest:
                    raise ValueError("content_hash_mismatch")
                staged = f"{self.staging}/{folder}/{digest}"
                if not os.path.exists(staged) and not os.path.exists(self._final(digest)):
                    with open(staged, "wb") as out:
                        out.write(body)
        return Staged(folder, rows)

    def _final(self, digest: str) -> str:
        return f"{self.path}/{digest[:2]}/{digest[2:]}"

    def commit(self, messages: list[Staged | None]) -> None:
        added = 0
        for message in filter(None, messages):
            with os.scandir(f"{self.staging}/{message.folder}") as staged:
                for file in staged:
                    final = self._final(file.name)
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    if os.path.exists(final):
                        os.remove(file.path)
                    else:
                        os.replace(file.path, final)
                        added += 1
        os.makedirs(f"{self.path}/_writes", exist_ok=True)
        with open(f"{self.path}/_writes/{self.write_id}.json", "w") as out:
            json.dump({"rows": sum(m.rows for m in messages if m), "added": added}, out)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Drop this write's own folder, with what tasks that were run twice left in it."""
        if os.path.isdir(self.staging):
            for folder in os.listdir(self.staging):
                for name in os.listdir(f"{self.staging}/{folder}"):
                    os.remove(f"{self.staging}/{folder}/{name}")
                os.rmdir(f"{self.staging}/{folder}")
            os.rmdir(self.staging)


class BoardSource(DataSource):
    """``spark.read.format("boards")`` with ``transport`` (``module:function``), ``tenants``, ``pages``; ``df.write.format("boards").option("path", ...)`` keeps bodies by hash."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BoardReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BoardStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ContentWriter(dict(self.options))


def folder_page(path: str, tenant: str, page: int) -> bytes | None:
    """A transport: stored pages ``path/tenant/page.json`` of a folder that all machines share."""
    name = f"{path}/{tenant}/{page}.json"
    if not os.path.exists(name):
        return None
    with open(name, "rb") as f:
        return f.read()


def stored(spark, path: str):
    """``sha256, body`` of a content store; its names are checked against the bodies by the caller, if at all.

    Bodies lie in 256 folders by the first byte of their hash; tasks list these, so no list of files comes to the driver.
    """
    root = path.removeprefix("file://")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                folder = f"{root}/{part:02x}"
                if os.path.isdir(folder):
                    with os.scandir(folder) as files:
                        for file in files:
                            with open(file.path, "rb") as body:
                                yield pa.RecordBatch.from_arrays([pa.array([f"{part:02x}{file.name}"]), pa.array([body.read()], pa.binary())], ["sha256", "body"])

    return spark.range(0, 256, 1, 64).mapInArrow(read, STORED)
