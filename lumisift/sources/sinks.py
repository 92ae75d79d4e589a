"""An action on chunks of keys as a Spark data source: tasks send the chunks, and what became of each is a file of its own."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row


@dataclass
class Sent(WriterCommitMessage):
    """A task's chunks."""

    done: int = 0
    failed: int = 0
    skipped: int = 0


class OutcomeLog:
    """Files outcomes/<chunk>.json below a folder that Arrow's file systems open, and a file `stop` once a run has ended early."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))

    def has(self, name: str) -> bool:
        return self.store.get_file_info(f"{self.root}/{name}").type == fs.FileType.File

    def outcome(self, chunk: str) -> str | None:
        name = f"outcomes/{chunk}.json"
        if not self.has(name):
            return None
        with self.store.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())["outcome"]

    def write(self, name: str, row: dict) -> None:
        """Written beside and moved, so that no reader sees half of it."""
        folder = f"{self.root}/{name}".rpartition("/")[0]
        self.store.create_dir(folder)
        part = f"{self.root}/_{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as f:
            f.write((json.dumps(row) + "\n").encode())
        self.store.move(part, f"{self.root}/{name}")


def chunk_sink(sink: Callable[[list[str]], object], fatal: type[Exception]) -> type[DataSource]:
    """A data source `chunk_sink` (option log) for rows (chunk, id, dedup_key) that lie chunk by chunk in their partitions."""

    class Writer(DataSourceWriter):
        def __init__(self, path: str):
            self.path = path

        def write(self, iterator: Iterator[Row]) -> Sent:
            log, out = OutcomeLog(self.path), Sent()
            log.store.create_dir(f"{log.root}/outcomes")
            for chunk, rows in groupby(iterator, key=lambda r: r.chunk):
                keys = [r.dedup_key for r in rows]
                if log.outcome(chunk) == "done":
                    out.skipped += 1
                    continue
                if log.has("stop"):
                    break
                try:
                    sink(keys)
                except Exception as e:  # the action is foreign code: any failure is an outcome
                    log.write(f"outcomes/{chunk}.json", {"chunk": chunk, "outcome": "failed", "error": str(e)})
                    out.failed += 1
                    if isinstance(e, fatal):
                        log.write("stop", {"error": str(e)})
                        break
                else:
                    log.write(f"outcomes/{chunk}.json", {"chunk": chunk, "outcome": "done", "error": None})
                    out.done += 1
            for _ in iterator:  # what isn't sent is read to its end
                pass
            return out

        def commit(self, messages: list[Sent | None]) -> None:
            pass  # outcomes are with their chunks

        def abort(self, messages: list[Sent | None]) -> None:
            pass  # what was sent stays sent, and is known

    class ChunkSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "chunk_sink"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer(self.options["log"])

    return ChunkSink
