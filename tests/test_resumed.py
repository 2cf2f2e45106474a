"""What is taken up again where it was left: the update log's partitions, replies, pages of a search; and counters of a pass."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loresmith.operators import counters, extract, incremental
from loresmith.sources import forum_stream
from loresmith.streaming import polls


def test_a_batch_rewrites_its_partitions_alone(spark, tmp_path):
    root = f"{tmp_path}/log"
    times = lambda: {p: os.stat(os.path.join(root, p)).st_mtime_ns for p in os.listdir(root) if p.startswith("bucket=")}
    files = lambda: {p: sorted(os.listdir(os.path.join(root, p))) for p in times()}
    kind = "service_key string, ts string, total long"
    polls.upsert_into(spark, spark.createDataFrame([(f"k{i}", "a", i) for i in range(300)], kind), root)
    before = files()
    assert len(before) > 40
    for _ in range(2):  # a batch that is run again changes nothing
        polls.upsert_into(spark, spark.createDataFrame([("k7", "b", 70)], kind), root)
        after = files()
        assert sum(before[p] != after[p] for p in before) == 1 and set(after) == set(before)
        got = {r["service_key"]: r["total"] for r in polls.read_log(spark, root).collect()}
        assert got == {f"k{i}": i for i in range(300)} | {"k7": 70}
    polls.upsert_into(spark, spark.createDataFrame([("new", "b", 1)], kind), root)
    assert polls.read_log(spark, root).count() == 301


def test_latest_of_one_time(spark):
    rows = [("a", "1", 3, "x"), ("a", "1", 5, "b"), ("a", "1", 5, "c"), ("a", "0", 9, "z"), ("b", None, 1, None)]
    for some in (rows, rows[::-1]):
        got = incremental.latest(spark.createDataFrame(some, "service_key string, ts string, n int, t string")).collect()
        assert sorted(map(tuple, got)) == [("a", "1", 5, "c"), ("b", None, 1, None)]


class Counting:
    """Answers, notes whom it was asked, and fails where it is told to."""

    def __init__(self, folder, bad):
        self.folder, self.bad = folder, bad

    def __call__(self, prompt):
        name = prompt.split("\n")[0].removeprefix("Service: ")
        with open(os.path.join(self.folder, name), "a") as f:
            f.write("x")
        if name in self.bad:
            raise ValueError("down")
        return "nothing" if name == "mute" else json.dumps({"tips": [name], "setttings": {"a": 1}})


def test_what_is_missing_is_asked_and_nothing_twice(spark, tmp_path):
    folder, path = tmp_path / "asked", f"{tmp_path}/replies"
    folder.mkdir()
    names = [f"s{i}" for i in range(20)] + ["mute", "s3"]
    posts = F.array(F.struct(F.lit(1).cast("long").alias("post_id"), F.lit("t").alias("title"), F.lit("c").alias("content")))
    batches = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "service string, batch int").withColumn("posts", posts)
    with pytest.raises(extract.Unanswered):
        extract.extract_resumable(batches, lambda: Counting(str(folder), {"s5", "s6"}), path, rounds=3)
    got = extract.extract_resumable(batches, lambda: Counting(str(folder), set()), path, rounds=3)
    for _ in range(2):
        rows = {(r["service"], r["batch"]): (r["tips"], r["settings"], r["error"]) for r in got.collect()}
        assert rows == {(n, i): ([], [], "no JSON in the reply") if n == "mute" else ([n], ["a = 1"], None) for i, n in enumerate(names)}
    asked = {p.name: len(p.read_text()) for p in folder.iterdir()}
    assert asked == {n: 2 if n in ("s5", "s6") else 3 if n == "mute" else 1 for n in names}


def page(folder, name, ids, after):
    posts = [{"data": {"id": i, "title": f"t{i}", "selftext": "x" * 600, "permalink": f"/p/{i}", "score": 3, "subreddit": "r", "num_comments": 1}} for i in ids]
    (folder / f"{name}.json").write_text(json.dumps({"data": {"children": posts, "after": after}}))


def test_pages_are_read_once_and_in_their_chain(spark, tmp_path):
    """Runs go on from the cursor read last; pages landed out of turn wait for the one before them."""
    folder = tmp_path / "pages"
    folder.mkdir()
    spark.dataSource.register(forum_stream.ForumPages)

    def run():
        stream = spark.readStream.format("forum_pages").option("path", str(folder)).load()
        polls.run_available(stream, f"{tmp_path}/posts", f"{tmp_path}/state")
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/posts").collect())

    page(folder, "first", ["a", "b"], "t3_b")
    page(folder, "t3_d", ["e"], "t3_e")
    assert run() == ["a", "b"]
    page(folder, "t3_b", ["c", "d"], "t3_d")
    assert run() == ["a", "b", "c", "d", "e"] and run() == ["a", "b", "c", "d", "e"]
    for k in range(5):
        page(folder, f"t3_{'e' if not k else k}", [f"f{k}"], f"t3_{k + 1}" if k < 4 else None)
    assert run() == ["a", "b", "c", "d", "e", *(f"f{k}" for k in range(5))]
    page(folder, "t3_4", ["f4"], "t3_b")  # a chain that bites its tail ends
    assert len(run()) == 10


def test_counters_of_a_pass(spark, tmp_path):
    rows = [("a", 1, ["p"], None, [], ["s", "t"], 4, None), ("a", 2, [], [], [], [], 2, None), ("b", 1, [], [], [], [], None, "down")]
    df = spark.createDataFrame(rows, extract.SCHEMA)
    run = counters.Counters("run")
    run.on(df, counters.run_metrics()).write.parquet(f"{tmp_path}/out")
    assert run.get() == {"batches": 3, "posts": 6, "failed": 1, "empty": 1, "n_problems": 1, "n_tips": 0, "n_cost_info": 0, "n_settings": 2}
    total = counters.Totals("seen")
    spark.streams.addListener(total)
    try:
        for k in range(2):
            spark.createDataFrame([(i,) for i in range(5 + k)], "n int").write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("n int").parquet(f"{tmp_path}/in").observe("seen", F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum"))
            polls.run_available(stream, f"{tmp_path}/s", f"{tmp_path}/c")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(100):
            if total.totals.get("rows") == 11:
                break
            time.sleep(0.1)
        assert total.totals == {"rows": 11, "sum": 25}
    finally:
        spark.streams.removeListener(total)


def test_extraction_holds_few_batches_at_once(spark, monkeypatch):
    """What a task holds as Python objects is AT_ONCE batches, however many Arrow hands over."""
    posts = spark.range(300).selectExpr("'s' AS service", "CAST(id AS INT) AS batch", "array(struct(id AS post_id, 'T' AS title, concat('Use x', id, '.') AS content)) AS posts").coalesce(1)
    monkeypatch.setattr(type(posts), "mapInArrow", lambda df, run, schema: (run, schema))
    run, _ = extract.extract(posts, extract.RuleExtractor)
    monkeypatch.undo()
    sent = list(run(iter(posts.toArrow().to_batches())))
    assert [b.num_rows for b in sent] == [64, 64, 64, 64, 44]
    assert {r["batch"]: r["tips"] for b in sent for r in b.to_pylist()} == {i: [f"Use x{i}."] for i in range(300)}
