"""A Python data source over landed forum search pages (one JSON file a page), read page by page in parallel."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import parse_qs, urlparse

import pyarrow.fs as afs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_system(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ForumReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.most = options["path"], int(options.get("max_posts", 10))
        query = parse_qs(urlparse(options.get("url", "?q=*")).query).get("q", [])
        self.empty = not query  # a search without a query finds nothing

    def partitions(self):
        if self.empty:
            return []
        fs, root = file_system(self.root)
        return [Page(f.path) for f in sorted(fs.get_file_info(afs.FileSelector(root)), key=lambda f: f.path) if f.is_file and f.path.endswith(".json")]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # no pages
            return
        with file_system(self.root)[0].open_input_stream(partition.path) as f:
            children = json.loads(f.readall()).get("data", {}).get("children", [])
        for child in children[: self.most]:
            d = child.get("data", {})
            yield (d.get("id"), d.get("title"), (d.get("selftext") or "")[:500], "https://reddit.com" + d.get("permalink", ""), int(d.get("score") or 0), d.get("subreddit"), int(d.get("num_comments") or 0))


class ForumSource(DataSource):
    """spark.dataSource.register(ForumSource); spark.read.format("forum").option("url", ...).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "forum"

    def schema(self) -> str:
        return "id string, title string, content string, url string, score int, subreddit string, num_comments int"

    def reader(self, schema) -> DataSourceReader:
        return ForumReader(self.options)
