"""The catalogue's versions as a stream of ids.

An offset is a version number. A batch's partitions are the parts that have changed between two versions, and a partition's rows are
the ids in its part that a pass still wants by two plain flags; the pass looks at the rows again, as a later version may have settled them.
A part that is no longer there has been replaced since, and a later batch has its successor. The folder is read through Arrow's file systems.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Columns that decide, and rows of which a pass may still want something.
WANTED = {
    "analysis": (["id", "analyzed"], lambda t: pc.invert(pc.fill_null(t["analyzed"], False))),
    "faces": (["id", "analyzed", "people_scanned"], lambda t: pc.and_(pc.fill_null(t["analyzed"], False), pc.invert(pc.fill_null(t["people_scanned"], False)))),
}


class CatalogueChanges(DataSource):
    """Options: path (a catalogue), want (analysis or faces)."""

    @classmethod
    def name(cls) -> str:
        return "catalogue_changes"

    def schema(self) -> str:
        return "id string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangesReader(self.options["path"], self.options["want"])


class Part(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class ChangesReader(DataSourceStreamReader):
    def __init__(self, path: str, want: str):
        self.path, self.want = re.sub(r"^file:/+", "/", path), want

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _versions(self) -> list[int]:
        store, root = self._open()
        names = (f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))
        return sorted(int(n[7:-5]) for n in names if n.startswith("items.v"))

    def _folders(self, version: int) -> set[str]:
        """The parts' folders at a version; none where its file is gone."""
        store, root = self._open()
        try:
            with store.open_input_stream(f"{root}/items.v{version:012d}.json") as f:
                return set(json.loads(f.read())["files"].values())
        except FileNotFoundError:
            return set()

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": max(self._versions(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # a replayed end that is gone: the oldest version since then has its rows, or what has become of them
        last = next((v for v in self._versions() if v >= end["version"]), 0)
        return [Part(f) for f in sorted(self._folders(last) - self._folders(start["version"]))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, root = self._open()
        columns, wanted = WANTED[self.want]
        try:
            rows = dataset.dataset(f"{root}/{partition.folder}", filesystem=store, format="parquet").to_batches(columns=columns)
            for batch in rows:
                ids = batch.filter(wanted(batch)).select(["id"])
                if ids.num_rows:
                    yield ids
        except FileNotFoundError:
            return
