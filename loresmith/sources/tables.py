"""Scans: the driver's tables as posts, services, threads and extractions; files as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.functions import names
from loresmith.sources.forum import file_system


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum posts: title is the first line, content the first 500 characters."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("post_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.substring("text", 1, 500).alias("content"), F.col("source").alias("community"), F.col("n_chars").alias("score"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered services in order of discovery."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.lower("p_type").alias("category"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
        F.concat(F.lit("https://"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 3 == 0, ".ai/docs").when(F.col("p_partkey") % 3 == 1, ".org/blog/x").otherwise(".org")).alias("url"),
        F.col("p_brand").alias("source"),
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an extracted item: (ord, service, list_name, item, batch_size, timestamp)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("Svc"), F.col("user_id").cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "problems").when(F.col("event_type") == "click", "tips").when(F.col("event_type") == "purchase", "cost_info").otherwise("settings").alias("list_name"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("item"), F.lit(1).cast("long").alias("batch_size"), F.col("ts"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


#: Files, and bytes of their contents, that a task sends on at once.
SENT_FILES, SENT_BYTES = 1000, 8_000_000
_LISTED = "path string, folder boolean, modified long"


def _seen(found: Iterator[afs.FileInfo], below: str) -> Iterator[tuple[str, bool, int]]:
    """(path, folder, modified) of what a listing found, without what Spark's scans take for hidden: names that begin with '_' or '.'."""
    for f in found:
        parts = f.path[len(below) :].strip("/").split("/")
        if not any((p[0] == "_" and "=" not in p) or p[0] == "." or p.endswith("._COPYING_") for p in parts):
            yield f.path, f.type == afs.FileType.Directory, f.mtime_ns // 1_000_000


def _opened(spark: SparkSession, root: str) -> str | None:
    """A folder as pyarrow opens it, None where only Spark does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    path = uri.getPath() if uri.getScheme() == "file" else uri.toString()
    try:
        file_system(path)
    except (pa.ArrowException, OSError, NotImplementedError):
        return None
    return path


def _read_in_tasks(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified) of all files: the driver lists the first level alone, tasks the second and what is below, and read the files."""
    _, top = file_system(root)

    def listed(recursive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs = file_system(root)[0]
            for b in batches:
                for path, folder, modified in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    rows = list(_seen(fs.get_file_info(afs.FileSelector(path, recursive=recursive)), path)) if folder else [(path, False, modified)]
                    for at in range(0, len(rows), SENT_FILES):
                        yield pa.RecordBatch.from_pylist([dict(zip(("path", "folder", "modified"), r, strict=True)) for r in rows[at : at + SENT_FILES]], schema=kinds)

        kinds = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("modified", pa.int64())])
        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, out, held = file_system(root)[0], [], 0
        kinds = pa.schema([("path", pa.string()), ("content", pa.binary()), ("modified", pa.int64())])
        for b in batches:
            for path, modified in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    out.append({"path": path, "content": f.readall(), "modified": modified})
                held += len(out[-1]["content"])
                if len(out) >= SENT_FILES or held >= SENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = spark.createDataFrame(list(_seen(file_system(root)[0].get_file_info(afs.FileSelector(top)), top)), _LISTED)
    second = first.repartition(n, "path").mapInArrow(listed(False), _LISTED)
    files = second.repartition(n, "path").mapInArrow(listed(True), _LISTED).where("not folder").select("path", "modified")
    found = files.repartition(n, "path").mapInArrow(read, "path string, content binary, modified long")
    return found.select("path", F.col("content").cast("string").alias("content"), F.timestamp_millis("modified").alias("modified"))


def _read_by_scan(spark: SparkSession, root: str) -> DataFrame:
    """The same where pyarrow has no file system. A scan skips files without bytes; those come from the file system's listing."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))
    jvm, blank = spark._jvm, []
    at = jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            blank.append((f.getPath().toString(), "", f.getModificationTime() / 1000))
    return raw.unionByName(spark.createDataFrame(blank, "path string, content string, modified double").withColumn("modified", F.timestamp_seconds("modified")))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """A document tree <category>/<slug>/<file>: one row a file, those without bytes too."""
    path = _opened(spark, root)
    raw = _read_by_scan(spark, root) if path is None else _read_in_tasks(spark, path)
    tail = r"([^/]+)/([^/]+)/([^/]+)$"
    return raw.select(*(F.regexp_extract("path", tail, i).alias(c) for i, c in ((1, "category"), (2, "slug"), (3, "file"))), "content", "modified")


def registry_file(spark: SparkSession, path: str) -> DataFrame:
    """A registry's services, one row each; a missing file is an empty registry."""
    schema = "services map<string, struct<canonical_name:string, display_name:string, aliases:array<string>, category:string, description:string, url:string, sources:array<string>, first_seen:string, last_seen:string>>"
    try:
        raw = spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:  # a first run has no registry yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    return raw.select(F.explode(F.map_entries("services")).alias("s")).select("s.key", "s.value.*")


_SOURCE = "source_type string, name string, url string, focus string, priority string, models array<string>"


def _sources_of(text: str | None) -> list[tuple]:
    import yaml

    rows, found = [], yaml.safe_load(text or "")
    for kind, section in found.items() if isinstance(found, dict) else ():
        for s in (section.get("sources") or []) if isinstance(section, dict) else ():
            rows.append((kind, s.get("name"), s.get("url"), s.get("focus"), s.get("priority"), [str(m) for m in s.get("models") or []]))
    return rows


def source_config(spark: SparkSession, text: str) -> DataFrame:
    """Sources of one YAML file's text: (ord, source_type, name, url, focus, priority, models)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(_sources_of(text))], f"ord int, {_SOURCE}")


def source_configs(files: DataFrame) -> DataFrame:
    """The same of many files, parsed in tasks: (path, ord, source_type, ...). files: (path, content).

    A text that is no YAML fails with its path, as a file that is no configuration would: none is passed over.
    """
    path_type = files.schema["path"].dataType.simpleString()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, i, *r) for i, r in enumerate(_sources_of(content))]
                except Exception as e:
                    raise ValueError(f"no configuration: {path}") from e
            yield pd.DataFrame(rows, columns=["path", "ord", "source_type", "name", "url", "focus", "priority", "models"])

    return files.select("path", "content").mapInPandas(parse, f"path {path_type}, ord int, {_SOURCE}")


def curated_list(lists: DataFrame) -> DataFrame:
    """Entries of curated markdown lists (source, content): linked ones first, then bold ones, as they stand.

    (source, form, pos, name, url, description)
    """
    link, bold = r"\[([^\]]+)\]\(([^)]+)\)\s*[-–—:]\s*([^\n]+)", r"\*\*([^*]+)\*\*\s*[-–—:]\s*([^\n]+)"
    every = lambda p, i: F.regexp_extract_all("content", F.lit(p), F.lit(i))
    linked = lists.select("source", F.lit(0).alias("form"), F.posexplode(F.arrays_zip(every(link, 1).alias("name"), every(link, 2).alias("url"), every(link, 3).alias("description"))).alias("pos", "e"))
    marked = lists.select("source", F.lit(1).alias("form"), F.posexplode(F.arrays_zip(every(bold, 1).alias("name"), F.transform(every(bold, 1), lambda _: F.lit("")).alias("url"), every(bold, 2).alias("description"))).alias("pos", "e"))
    return linked.unionByName(marked).select("source", "form", "pos", "e.name", "e.url", F.trim("e.description").alias("description"))


def discover(lists: DataFrame) -> DataFrame:
    """Services of curated lists, cleaned and categorised."""
    e = curated_list(lists)
    return e.where(names.is_service(F.col("name"), F.col("url"), F.col("description"))).select(
        names.clean(F.col("name")).alias("name"), "url", "description", names.category(F.col("name"), F.col("description")).alias("category"), "source", "form", "pos"
    )


def thread_posts(turns: DataFrame, first: int = 5, longer_than: int = 50) -> DataFrame:
    """Threads with their first comments, of those the longer ones: cap first, filter next."""
    t = turns.withColumn("nth", F.row_number().over(_window("conv_id", "turn")))
    t = t.where(F.col("nth") <= first + 1)
    return t.groupBy("conv_id").agg(
        F.max(F.when(F.col("nth") == 1, F.col("text"))).alias("body"),
        F.array_sort(F.collect_list(F.when((F.col("nth") > 1) & (F.length("text") > longer_than), F.struct("nth", "text")))).alias("c"),
    ).select("conv_id", "body", F.size("c").cast("long").alias("n_comments"), F.concat_ws("\n\n", F.array(F.col("body")), F.transform("c", lambda x: x["text"])).alias("full_content"))


def _window(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)
