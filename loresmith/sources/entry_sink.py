"""A sink for document trees: tasks write files under their own names, one step at the end makes them current.

``df.write.format("entry_tree").mode("append").option("path", root).save()`` of (category, slug, file, content) writes a version
<root>/<version>/<category>/<slug>/<file>, each task its own files, and then the pointer <root>/_current that names it. The
pointer is replaced by a rename, so readers see the version before or the whole new one. A job that fails deletes its
version and leaves the pointer as it was; a task that is run again writes the same files again. Messages name no
files, so what the driver gets is a number a task. Paths are those that pyarrow opens.

A path part must be a plain name: null, empty, '.', '..', names with a slash and those that begin with '_' fail the job. Null
contents are empty files; of rows of one path the last written stands.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as afs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loresmith.sources.forum import file_system

POINTER = "_current"


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote."""

    files: int


def _named(part) -> str:
    if not part or part in (".", "..") or "/" in part or "\\" in part or part[0] == "_":
        raise ValueError(f"not a name for a path: {part!r}")
    return part


class EntryWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.version = root.rstrip("/"), f"v-{uuid.uuid4().hex[:16]}"

    def _put(self, fs: afs.FileSystem, path: str, content: bytes) -> None:
        """Whole or not at all: written beside its place, then renamed."""
        beside = f"{path}.{uuid.uuid4().hex[:8]}.part"
        with fs.open_output_stream(beside) as f:
            f.write(content)
        fs.move(beside, path)

    def write(self, iterator: Iterator) -> Written:
        fs, root = file_system(self.root)
        made, n = set(), 0
        for row in iterator:
            folder = f"{root}/{self.version}/{_named(row['category'])}/{_named(row['slug'])}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made = made if len(made) < 10_000 else set()
                made.add(folder)
            self._put(fs, f"{folder}/{_named(row['file'])}", (row["content"] or "").encode())
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        fs, root = file_system(self.root)
        fs.create_dir(f"{root}/{self.version}", recursive=True)  # of no rows
        self._put(fs, f"{root}/{POINTER}", f"{self.version} {sum(m.files for m in messages if m is not None)}".encode())

    def abort(self, messages: list) -> None:
        fs, root = file_system(self.root)
        if fs.get_file_info(f"{root}/{self.version}").type != afs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.version}")


class EntrySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entry_tree"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return EntryWriter(self.options["path"])


def current(root: str) -> str:
    """The folder of the version that readers see."""
    fs, path = file_system(root.rstrip("/"))
    with fs.open_input_stream(f"{path}/{POINTER}") as f:
        return f"{root.rstrip('/')}/{f.readall().decode().split()[0]}"


def discard_old(root: str) -> int:
    """Delete the versions that the pointer does not name, once no reader needs them; how many."""
    fs, path = file_system(root.rstrip("/"))
    keep = current(root).rsplit("/", 1)[1]
    old = [f.path for f in fs.get_file_info(afs.FileSelector(path)) if f.type == afs.FileType.Directory and f.base_name.startswith("v-") and f.base_name != keep]
    for p in old:
        fs.delete_dir(p)
    return len(old)
