"""Saved answers of indexes as a Spark data source: ``spark.read.format("payloads").load(folder)``.

The folder holds a folder for each source, with files of JSON lines: ``{"id": ..., "payload": ...}``, where the id is a DOI or
the source's own. Rows are (source, id, payload); the payload is JSON text for the adapters in ``payloads``.

Filters on ``source`` choose folders before anything is read, filters on ``id`` are applied while a file is read, so that other
payloads never reach Spark; ``register`` turns on the session option that this needs. A file is one task. Null ids and payloads stay null; an empty line is no row; a line that is no JSON object has a null id and
itself as payload, so nothing is lost in silence. A folder without files gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT, SCHEMA = "payloads", "source string, id string, payload string"


@dataclass
class SavedFile(InputPartition):
    source: str
    path: str


@dataclass
class SavedReader(DataSourceReader):
    root: str
    #: column -> the values that its filters leave
    wanted: dict[str, set[str]] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("source",), ("id",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[SavedFile]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        names = ((f.path, f.path.removeprefix(top).strip("/").split("/")) for f in found if f.type == fs.FileType.File)
        files = [SavedFile(parts[0], path) for path, parts in names if len(parts) == 2 and parts[1][0] not in "._"]
        sources = self.wanted.get("source")
        return sorted((f for f in files if sources is None or f.source in sources), key=lambda f: f.path)

    def read(self, partition: SavedFile) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.root)
        ids = self.wanted.get("id")
        with store.open_input_stream(partition.path) as raw:
            for name, payload in map(_row, filter(None, _lines(raw))):
                if ids is None or name in ids:
                    yield partition.source, name, payload


def _lines(raw) -> Iterator[str]:
    rest = b""
    while piece := raw.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x.decode("utf-8", "replace").strip() for x in whole)
    yield rest.decode("utf-8", "replace").strip()


def _row(line: str) -> tuple[str | None, str | None]:
    try:
        read = json.loads(line)
    except ValueError:
        read = None
    if not isinstance(read, dict):
        return None, line
    name, payload = read.get("id"), read.get("payload")
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    return None if name is None else str(name), text


class SavedPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SavedReader:
        return SavedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach Python data sources in it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedPayloads)
