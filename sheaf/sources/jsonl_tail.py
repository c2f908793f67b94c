"""A streaming source that follows growing JSON-lines files by byte offset."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "file string, offset long, line string"
#: Bytes of a file that one batch takes, about: whole lines, so a longer line is taken by itself.
BATCH_BYTES = 16 << 20


def complete_lines(path: str, offset: int) -> tuple[int, list[tuple[int, str]]]:
    """The next offset and the whole lines from `offset` on, each with its own; a last line without its end waits."""
    if not os.path.exists(path):
        return offset, []
    with open(path, "rb") as handle:
        handle.seek(offset)
        body = handle.read(BATCH_BYTES)
        while b"\n" not in body and (more := handle.read(BATCH_BYTES)):
            body += more
    body = body[: body.rfind(b"\n") + 1]
    found, at = [], offset
    for line in body.splitlines(keepends=True):
        text = line.decode("utf-8", "replace").strip()
        if text and _is_json(text):
            found.append((at, text))
        at += len(line)
    return offset + len(body), found


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class _TailReader(SimpleDataSourceStreamReader):
    """Offsets are {file: bytes}, so a restart goes on where the last committed batch ended."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[str]:
        return sorted(f for f in os.listdir(self.folder) if f.endswith(".jsonl")) if os.path.isdir(self.folder) else []

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, ends = [], dict(start)
        for name in self._files():
            ends[name], lines = complete_lines(os.path.join(self.folder, name), start.get(name, 0))
            rows += [(name, at, text) for at, text in lines]
        return iter(rows), ends

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for name, until in end.items():
            _, lines = complete_lines(os.path.join(self.folder, name), start.get(name, 0))
            yield from ((name, at, text) for at, text in lines if at < until)

    def commit(self, end: dict) -> None:
        pass


class JsonlTail(DataSource):
    """spark.readStream.format("jsonl_tail").option("path", folder); reads on the driver, for control-plane rates."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonlTail)
