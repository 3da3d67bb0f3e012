"""A paged service as a Spark data source: one partition a (site, language), token by token, with capped linear retries."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Feed(InputPartition):
    def __init__(self, site: str, lang: str):
        super().__init__(f"{site}|{lang}")
        self.site, self.lang = site, lang


class PagedReader(DataSourceReader):
    """fetch(site, lang, token) -> (rows, next token or None) is given as option `pages`: a JSON folder of recorded pages."""

    def __init__(self, options):
        self.root, self.feeds = options["pages"], json.loads(options["feeds"])
        self.most, self.retries = int(options.get("max_pages", 1000)), int(options.get("retries", 4))

    def partitions(self):
        return [_Feed(s, l) for s, l in self.feeds]

    def fetch(self, site: str, lang: str, token: str):
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(f"{self.root}/{site}-{lang}-{token}.json") if "://" in self.root else (fs.LocalFileSystem(), f"{self.root}/{site}-{lang}-{token}.json")
        with where.open_input_stream(at) as f:
            return json.loads(f.read())

    def read(self, partition) -> Iterator[tuple]:
        token, pages = "0", 0
        while token is not None and pages < self.most:
            for turn in range(self.retries + 1):
                try:
                    page = self.fetch(partition.site, partition.lang, token)
                    break
                except OSError:
                    if turn == self.retries:
                        raise
                    time.sleep(0.1 * (turn + 1))
            for r in page.get("claims", []):
                yield partition.site, partition.lang, r.get("text"), r.get("url"), r.get("rating")
            token, pages = page.get("nextPageToken"), pages + 1


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged_claims").option("pages", folder).option("feeds", json)"""

    @classmethod
    def name(cls) -> str:
        return "paged_claims"

    def schema(self) -> str:
        return "site string, lang string, claim_text string, review_url string, original_rating string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
