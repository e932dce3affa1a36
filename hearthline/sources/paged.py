"""Numbered pages of a list as a data source: spark.dataSource.register(PagedSource), then
spark.read.format("hearthline_pages").option("url", "https://x.org/list?page={page}").option("pages", 40).load()."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Range(InputPartition):
    first: int
    last: int


class PagedSource(DataSource):
    """page, payload, error. Options: url with {page}; pages, the last number; pages_a_task; per_page, how many records a full page has; timeout in seconds.

    A task reads its pages in order and stops after one that is empty, short or failed, since the list ends there; pages of later tasks may lie beyond that end, and
    until_stop drops them. A failed page is a row with its error and no payload.
    """

    @classmethod
    def name(cls) -> str:
        return "hearthline_pages"

    def schema(self) -> str:
        return "page int, payload string, error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.pages = options["url"], int(options.get("pages", 40))
        self.step, self.full, self.timeout = int(options.get("pages_a_task", 10)), int(options.get("per_page", 100)), float(options.get("timeout", 30))

    def partitions(self) -> list[Range]:
        return [Range(k, min(self.pages, k + self.step - 1)) for k in range(1, self.pages + 1, self.step)]

    def read(self, partition: Range) -> Iterator[tuple[int, str | None, str | None]]:
        for page in range(partition.first, partition.last + 1):
            try:
                with urllib.request.urlopen(self.url.format(page=page), timeout=self.timeout) as r:
                    payload = r.read().decode("utf-8", "replace")
                size = len(json.loads(payload))
            except (OSError, ValueError) as e:
                yield page, None, f"{type(e).__name__}: {e}"
                return
            yield page, payload, None
            if size < self.full:
                return
