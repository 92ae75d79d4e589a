"""A timeline of pages as a stream source: offsets are page tokens, and tasks fetch the pages, with retries.

A client says which pages follow a token and how far back each one reaches, without reading any; pages that lie wholly within a window that a run
leaves out are dropped when a batch is planned, and never fetched. A batch is whatever is there, dealt to tasks page by page.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lumisift.sources.pages import ListingError, with_retries


class PageClient(Protocol):
    """Tokens ascend from the newest page to the oldest; the empty token comes before all. Clients are sent to tasks."""

    def after(self, token: str) -> list[tuple[str, int | None]]:
        """Tokens of the pages that follow, each with the instant of its oldest item, where that is known."""

    def fetch(self, token: str) -> str:
        """A page's text, a page a line; ListingError says how it failed."""


class FolderClient:
    """Stored pages: files `<number>-<oldest instant>.jsonl`, or any other name, whose reach isn't known; opened by Arrow's file systems."""

    def __init__(self, folder: str):
        self.folder = re.sub(r"^file:/+", "/", folder)

    def after(self, token: str) -> list[tuple[str, int | None]]:
        store, root = fs.FileSystem.from_uri(self.folder)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", ".")))
        reach = lambda name: re.fullmatch(r"\d+-(\d+)\.jsonl", name)
        return [(n, int(m[1]) if (m := reach(n)) else None) for n in names if n > token]

    def fetch(self, token: str) -> str:
        store, root = fs.FileSystem.from_uri(self.folder)
        try:
            with store.open_input_stream(f"{root}/{token}") as f:
                return f.read().decode()
        except OSError as e:
            raise ListingError("network", str(e)) from e


class Pages(InputPartition):
    def __init__(self, tokens: list[str]):
        self.tokens = tokens


class PageReader(DataSourceStreamReader):
    def __init__(self, client: PageClient, older_than: int | None, per_task: int, retries: int, wait: float):
        self.client, self.older_than, self.per_task, self.retries, self.wait = client, older_than, per_task, retries, wait

    def initialOffset(self) -> dict:
        return {"token": ""}

    def latestOffset(self) -> dict:
        return {"token": max((t for t, _ in self.client.after("")), default="")}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        wanted = [t for t, oldest in self.client.after(start["token"]) if t <= end["token"] and (self.older_than is None or oldest is None or oldest < self.older_than)]
        return [Pages(wanted[i : i + self.per_task]) for i in range(0, len(wanted), self.per_task)]

    def read(self, partition: Pages) -> Iterator[tuple[str, str]]:
        for token in partition.tokens:
            yield token, with_retries(lambda: self.client.fetch(token), retries=self.retries, wait=self.wait, sleep=time.sleep)  # noqa: B023


def listing_source(client: PageClient, older_than: int | None = None, per_task: int = 20, retries: int = 4, wait: float = 0.6) -> type[DataSource]:
    """A data source `listing_pages` over a client's pages (file, value)."""

    class ListingPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "listing_pages"

        def schema(self) -> str:
            return "file string, value string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PageReader(client, older_than, per_task, retries, wait)

    return ListingPages


def stream_pages(spark: SparkSession, client: PageClient, older_than: int | None = None, **options) -> DataFrame:
    """The pages as a stream for list_pages. A run with another window needs a checkpoint of its own: what was left out is behind the old one."""
    spark.dataSource.register(listing_source(client, older_than, **options))
    return spark.readStream.format("listing_pages").load()
