"""A stream over landed forum search pages, following their cursors.

A page is a JSON file; the first is ``first.json``, and the one that follows a page is named by the ``after`` that it ends
with. The offset is the cursor of the page read last, so a run goes on where the last one ended, whatever was landed since.
``spark.readStream.format("forum_pages").option("path", folder).load()`` gives a row a post, in the columns of ``ForumSource``.

The driver opens each new page for its cursor, after a restart those before it too, and keeps the cursors; pages are read by tasks, a partition each. A page without a cursor ends
the chain until it is landed anew under the same name with one; a cursor that is seen again ends it too.
"""

from __future__ import annotations

import json
import os.path
from collections.abc import Iterator

import pyarrow.fs as afs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from loresmith.sources.forum import ForumReader, ForumSource, Page, file_system

FIRST = "first"


class PagesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.posts = ForumReader({**dict(options), "max_posts": options.get("max_posts", 100)})
        self.latest, self.seen = "", {""}

    def _after(self, cursor: str) -> str | None:
        """The cursor that a page ends with; None where the page is not there or is the last."""
        fs, root = file_system(self.root)
        path = os.path.join(root, f"{cursor}.json")
        if not cursor or "/" in cursor or fs.get_file_info(path).type != afs.FileType.File:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.readall()).get("data", {}).get("after")

    def _landed(self, cursor: str) -> bool:
        fs, root = file_system(self.root)
        return "/" not in cursor and fs.get_file_info(os.path.join(root, f"{cursor}.json")).type == afs.FileType.File

    def _following(self, read: str) -> Iterator[str]:
        """Landed pages after one, in order."""
        now = FIRST if not read else self._after(read)
        while now and self._landed(now):
            yield now
            now = self._after(now)

    def initialOffset(self) -> dict:
        return {"read": ""}

    def latestOffset(self) -> dict:
        for cursor in self._following(self.latest):
            if cursor in self.seen:
                break
            self.seen.add(cursor)
            self.latest = cursor
        return {"read": self.latest}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        if start["read"] != end["read"]:
            for cursor in self._following(start["read"]):
                out.append(Page(os.path.join(file_system(self.root)[1], f"{cursor}.json")))
                if cursor == end["read"]:
                    break
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.posts.read(partition)

    def commit(self, end: dict) -> None:
        pass


class ForumPages(DataSource):
    """spark.dataSource.register(ForumPages)"""

    @classmethod
    def name(cls) -> str:
        return "forum_pages"

    def schema(self) -> str:
        return ForumSource(self.options).schema()

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagesReader(self.options)
