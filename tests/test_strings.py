"""Joins of strings through indexes, mentions by an automaton, and keyed state, each against the plain thing."""

import random

import pytest
from pyspark.sql import functions as F

from loresmith.operators import resolve, search, strings
from loresmith.streaming import state


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(seed, n, alphabet="abcé"):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.6, 0.7, 0.85, 1.0])
def test_near_is_complete(spark, threshold):
    xs, ys = set(words(1, 60)) | {"aaaa", "abcabcabc"}, set(words(2, 60)) | {"aaaaa", "abcabcabd"}
    got = {(r["x"], r["y"], r["distance"]) for r in strings.near(spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string"), threshold).collect()}
    every = {(x, y, distance(x, y)) for x in xs for y in ys if x and y}
    assert got == {(x, y, n) for x, y, n in every if n <= (1 - threshold) * max(len(x), len(y)) + 1e-9}


def test_near_needs_a_threshold(spark):
    with pytest.raises(ValueError):
        strings.near(spark.createDataFrame([], "x string"), spark.createDataFrame([], "y string"), 0)


def test_holding_is_complete(spark):
    needles, hays = [*words(3, 80, "ab"), "", None, "abab"], [*words(4, 60, "ab"), "x" * 5000 + "abab", "", None]
    df = lambda c, xs: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = [(r["needle"], r["hay"]) for r in strings.holding(df("needle", needles), df("hay", hays)).collect()]
    want = {(n, h) for n in needles for h in hays if n is not None and h is not None and n in h}
    assert len(got) == len(set(got)) and set(got) == want
    assert strings.holding(df("needle", []), df("hay", hays)).count() == 0


def test_few_and_many_give_the_same(spark, monkeypatch):
    """A side that goes to every task and one that meets through the index."""
    q = spark.createDataFrame([(w,) for w in [*words(5, 25, "ab -"), None]], "query string")
    e = spark.createDataFrame([(i, w, "c") for i, w in enumerate(words(6, 40, "ab-"))], "ord int, name string, category string")
    known = spark.createDataFrame([(i, f"v/{w}", i) for i, w in enumerate(words(7, 30, "ab"))], "ord int, model_id string, context_length int")
    static = spark.createDataFrame([(i, f"c{i}", w) for i, w in enumerate(words(8, 20, "ab "))], "ord int, canonical string, variation string")

    def run():
        models = q.where("query is not null").select(F.col("query").alias("model"))
        return [sorted(map(str, df.collect())) for df in (search.fuzzy_matches(q, e), search.context_lengths(models, known), resolve.resolve(q, "query", static))]

    few = run()
    monkeypatch.setattr(strings, "FEW", 0)
    monkeypatch.setattr(strings, "FEW_HELD", 0)
    assert run() == few and all(few)
    plan = search.fuzzy_matches(q, e)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_mentions_by_automaton_and_by_index(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate([None, "", "The RED ring and a gear", "redgear", "Übergröße", "x" * 50_000 + "gear"])]
    aliases = [("a", "red"), ("a", "Ring"), ("b", "gear"), ("c", "größe"), ("d", ""), ("e", None), (None, "x"), ("f", "gear"), ("a", "red")]
    docs = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(aliases, "canonical string, spelling string")
    want = sorted({(i, c) for i, t in texts for c, s in aliases if None not in (t, c, s) and s.lower() in t.lower()})
    assert sorted((r["id"], r["canonical"]) for r in resolve.mentions_of(docs, "text", table).collect()) == want
    monkeypatch.setattr(resolve, "AUTOMATON", 3)
    assert sorted((r["id"], r["canonical"]) for r in resolve.mentions_of(docs, "text", table).collect()) == want
    assert resolve.mentions_of(docs, "text", table.where("false")).count() == 0


def test_last_scraped_restarts_and_expires(spark, tmp_path):
    """State outlives the run that made it, and leaves by its timer."""
    kind = "source string, ts timestamp"

    def arrive(n, rows):
        spark.createDataFrame(rows, "source string, ts string").select("source", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        state.run_due(spark, stream, f"{tmp_path}/out", f"{tmp_path}/state", delay="1 hour")
        return sorted((r["source"], str(r["ts"])[:16], r["first"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = arrive(1, [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 10:00:00"), (None, "2024-01-01 00:00:00"), ("b", None), ("a", "2024-01-02 00:00:00")])
    assert first == [("a", "2024-01-01 00:00", True)]
    second = arrive(2, [("a", "2024-01-02 00:00:01"), ("b", "2024-01-02 00:00:00")])
    assert second == [*first, ("a", "2024-01-02 00:00", False), ("b", "2024-01-02 00:00", True)]
    arrive(3, [("c", "2024-01-09 00:00:00")])  # the watermark passes all timers of a and b
    last = arrive(4, [("a", "2024-01-09 01:00:00")])
    assert ("a", "2024-01-09 01:00", True) in last and ("c", "2024-01-09 00:00", True) in last and len(last) == 5

