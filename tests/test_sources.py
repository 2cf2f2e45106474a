import json

from pyspark.sql import functions as F

from loresmith.operators import incremental, render, validate
from loresmith.sources import forum, html, tables
from loresmith.streaming import polls


def test_forum_source(spark, tmp_path):
    page = {"data": {"children": [{"data": {"id": f"p{i}", "title": "T", "selftext": "x" * 600, "permalink": f"/r/a/{i}", "score": i, "subreddit": "a", "num_comments": 1}} for i in range(12)]}}
    (tmp_path / "1.json").write_text(json.dumps(page))
    spark.dataSource.register(forum.ForumSource)
    df = spark.read.format("forum").option("url", "https://reddit.com/search?q=a+b").load(str(tmp_path))
    rows = df.collect()
    assert len(rows) == 10 and len(rows[0]["content"]) == 500 and rows[1]["url"] == "https://reddit.com/r/a/1"
    assert spark.read.format("forum").option("url", "https://reddit.com/search?x=1").load(str(tmp_path)).count() == 0


def test_corpus_and_validation(spark, tmp_path):
    root = tmp_path / "models" / "audio" / "zed"
    root.mkdir(parents=True)
    (root / "prompting.md").write_text("short")
    (root / "metadata.json").write_text('{"last_updated": "2020-01-01T00:00:00", "data_sources": ["x"]}')
    (root / "odd.txt").write_text("")
    tree = tables.corpus(spark, str(tmp_path / "models"))
    assert sorted((r["category"], r["slug"], r["file"]) for r in tree.collect()) == [("audio", "zed", "metadata.json"), ("audio", "zed", "odd.txt"), ("audio", "zed", "prompting.md")]
    got = {(r["rule"], r["message"]) for r in validate.corpus_findings(tree, "2024-01-01 00:00:00").collect()}
    assert got == {("short_file", "prompting.md"), ("outdated", "metadata.json"), ("empty_file", "odd.txt"), ("unexpected_file", "odd.txt")}
    m = render.manifest(tree).first()
    assert m["title"] == "zed" and set(m["paths"]) == {"prompting.md", "metadata.json"}


def test_corpus_is_read_in_tasks(spark, tmp_path, monkeypatch):
    """The driver asks for the first level only; marks of jobs, though without bytes, are no documents."""
    root = tmp_path / "models"
    for i in range(40):
        (root / "audio" / f"s{i}").mkdir(parents=True)
        (root / "audio" / f"s{i}" / "a.md").write_text("" if i % 2 else f"täxt {i}\n")
    (root / "_SUCCESS").write_text("")
    (root / "audio" / ".hidden.crc").write_text("x")
    asked, real = [], tables._seen
    monkeypatch.setattr(tables, "_seen", lambda found, below: asked.append(below) or real(found, below))
    rows = sorted(tuple(r) for r in tables.corpus(spark, str(root)).select("category", "slug", "file", "content").collect())
    assert rows == sorted(("audio", f"s{i}", "a.md", "" if i % 2 else f"täxt {i}\n") for i in range(40))
    assert asked == [str(root)]


def test_registry_file(spark, tmp_path):
    assert tables.registry_file(spark, str(tmp_path / "none.json")).count() == 0
    f = tmp_path / "services.json"
    f.write_text(json.dumps({"services": {"zed": {"canonical_name": "zed", "display_name": "Zed", "aliases": ["zed"]}}}))
    assert tables.registry_file(spark, str(f)).first()["display_name"] == "Zed"


def test_discover(spark):
    md = "- [Zed](https://zed.ai) - an image api\n- [A tutorial](https://x.ai) - how\n**Bee** : voice platform\n"
    got = [(r["name"], r["category"]) for r in tables.discover(spark.createDataFrame([("l", md)], "source string, content string")).orderBy("form").collect()]
    assert got == [("Zed", "image"), ("Bee", "audio")]


def test_html_items(spark):
    page = '<div class="post x"><h2>Head &amp; er</h2><script>no()</script> body <br>text</div><article>second</article><p>out</p>'
    rows = html.html_items(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("nth").collect()
    assert [(r["title"], r["content"]) for r in rows] == [("Head & er", "Head & er body text"), (None, "second")]


def test_upsert_stream(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "log")
    schema = "service_key string, ts timestamp, total long"
    write = lambda rows: spark.createDataFrame(rows, "service_key string, ts string, total long").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(src))
    write([("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:00", 1)])
    for _ in range(2):
        polls.upsert_log(spark, spark.readStream.schema(schema).parquet(str(src)), root, str(tmp_path / "cp"))
        write([("a", "2024-01-02 00:00:00", 2)])
    assert {r["service_key"]: r["total"] for r in polls.read_log(spark, root).collect()} == {"a": 2, "b": 1}


def test_changed(spark):
    a, b = (spark.createDataFrame(x, "k string, v string") for x in ([("x", "1"), ("y", "1"), ("z", None)], [("y", "2"), ("z", None), ("w", "1")]))
    assert {tuple(r) for r in incremental.changed(a, b, "k", "v").collect()} == {("x", "removed"), ("y", "changed"), ("w", "added")}
