"""Polling with pauses and caps, providers around extractors, configurations and catalogues read in tasks, coverage of plans, keys of parameters."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loresmith.operators import extract, registry, render
from loresmith.sources import state, tables
from loresmith.streaming import polls


def test_polling_goes_on_after_failures(spark, tmp_path):
    slept, runs = [], []
    (tmp_path / "in").mkdir()

    def run():
        runs.append(len(runs))
        if len(runs) == 2:
            raise OSError("down")
        spark.createDataFrame([(len(runs),)], "n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        polls.run_available(spark.readStream.schema("n int").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")

    failures = polls.keep_polling(run, hours=6, after_error=300, rounds=4, sleep=slept.append)
    assert slept == [21600, 300, 21600] and [str(e) for e in failures] == ["down"]
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3, 4]

    def down():
        raise ValueError

    assert len(polls.keep_polling(down, rounds=150, sleep=lambda s: None)) == 100


def test_capped(spark):
    rows = [("a", i) for i in range(5000)] + [("b", 1), ("b", 2), (None, 7)]
    df = spark.createDataFrame(rows, "source string, n int").repartition(6)
    found = polls.capped(df, 10, "n")
    assert sorted((r["source"] or "", r["n"]) for r in found.collect()) == [("", 7), ("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    assert polls.capped(df, 2, "n").count() == 0 and polls.capped(df.limit(0), 5, "n").count() == 0


def test_limits_and_paces():
    slow = extract.Limited(lambda p: time.sleep(5) or "late", 0.05)
    with pytest.raises(TimeoutError):
        slow("x")
    assert extract.Limited(str.upper, 5)("x") == "X"
    with pytest.raises(PermissionError):  # the key is refused: never asked again

        def refused(prompt):
            raise PermissionError("key")

        extract.Retrying(extract.Limited(refused), sleep=lambda s: pytest.fail("asked again"))("x")
    now, slept = [0.0], []

    def ask(prompt):
        now[0] += 0.25
        return prompt

    def sleep(s):
        slept.append(s)
        now[0] += s

    paced = extract.Paced(ask, 1, lambda: now[0], sleep)
    assert [paced(p) for p in "abc"] == ["a", "b", "c"] and slept == [1, 1]
    now[0] += 9
    assert paced("d") == "d" and len(slept) == 2
    waits = []

    def always(prompt):
        raise OSError("busy")

    assert extract.Retrying(always, 3, waits.append)("x") == "{}" and waits == [2, 4]
    with pytest.raises(OSError):
        extract.Retrying(always, 2, waits.append, last=None)("x")


def test_providers(spark, tmp_path):
    providers = {"rules": extract.Provider(extract.RuleExtractor), "slow": extract.Provider(lambda: lambda p: time.sleep(3), limit=0.05)}
    with pytest.raises(ValueError, match="rules, slow"):
        extract.provided("cloud", providers)
    batches = spark.sql("SELECT 'Zed' AS service, 0 AS batch, array(named_struct('post_id', 'p', 'title', 'Zed', 'content', 'The price is $5. Try it.')) AS posts")
    r = extract.extract(batches, extract.provided("rules", providers)).first()
    assert r["cost_info"] == ["The price is $5."] and r["tips"] == ["Try it."] and r["error"] is None
    path = f"{tmp_path}/replies"
    with pytest.raises(extract.Unanswered):  # a failure is not kept as an empty reply
        extract.extract_resumable(batches, extract.provided("slow", providers, tries=1, last=None), path, rounds=1)
    assert extract.extract_resumable(batches, extract.provided("rules", providers, last=None), path, rounds=1).first()["tips"] == ["Try it."]


def test_configurations_in_tasks(spark):
    files = [(1, "reddit:\n  sources:\n    - {name: r/A, url: 'https://reddit.com/r/A', priority: high, models: [general, 4]}\ngithub:\n  sources:\n"), (2, ""), (3, None), (4, "just text"),
             (0, "github:\n  sources:\n    - {url: 'https://github.com/x/y/', priority: high}\nversion: 2\n")]
    df = spark.createDataFrame(files, "path int, content string").repartition(3)
    s = tables.source_configs(df)
    assert sorted((r["path"], r["ord"], r["source_type"], r["name"], tuple(r["models"])) for r in s.collect()) == [(0, 0, "github", None, ()), (1, 0, "reddit", "r/A", ("general", "4"))]
    assert state.default_sources(s) == ["github:x/y", "reddit:A"] and tables.source_configs(df.limit(0)).count() == 0
    one = tables.source_config(spark, files[0][1])
    assert [tuple(r)[1:] for r in one.collect()] == [tuple(r)[2:] for r in s.where("path = 1").collect()]
    with pytest.raises(Exception, match="no configuration: 9"):
        tables.source_configs(spark.createDataFrame([(9, "a: [")], "path int, content string")).collect()


def test_catalogues_in_tasks(spark):
    pages = [(2, json.dumps({"data": [{"id": "a", "context_length": 9}, {"id": "c", "context_length": 200000, "name": "C", "pricing": {"prompt": 0}}]})), (1, json.dumps({"data": [{"id": "a", "context_length": 7}, {"id": "b"}]})),
             (3, "no JSON"), (4, None), (5, "{}")]
    k = state.catalogue_contexts(spark.createDataFrame(pages, "page int, content string"))
    assert [(r["model_id"], r["context_length"], r["name"], tuple(r["ord"])) for r in k.orderBy("ord").collect()] == [("a", 9, "a", (1, 0)), ("b", 4096, "b", (1, 1)), ("c", 200000, "C", (2, 1))]
    assert tuple(state.context_stats(k).first()) == (3, 1, 1) and [r["model_id"] for r in state.largest_contexts(k).collect()] == ["c"]
    assert tuple(state.context_stats(k.limit(0)).first()) == (0, 0, 0)


def test_coverage(spark):
    q = spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "service string")
    assert {r["service"]: tuple(r)[1:] for r in registry.coverage(q, 2).collect()} == {"a": (5, 2, 3), "b": (1, 1, 0), None: (6, 3, 3)}
    assert [tuple(r) for r in registry.coverage(q.limit(0), 2).collect()] in ([], [(None, 0, 0, 0)])


def test_parameter_keys_are_the_fold(spark):
    words, r = ["a", "Break tag", "slower", "break", "speech rate", "tag", None], random.Random(5)
    lists = [[], *([r.choice(words) for _ in range(r.randrange(1, 12))] for _ in range(200))]

    def fold(items):
        out = {}
        for x in items:
            low = (x or "").lower()
            kind = "speech_pauses" if "break" in low and "tag" in low else "speech_rate" if "speech rate" in low or "slower" in low else f"setting_{len(out)}"
            out[kind] = x
        return list(out.items())

    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "i int, items array<string>")
    found = {r["i"]: r["k"] for r in df.select("i", render.setting_keys(F.col("items")).alias("k")).collect()}
    assert all([tuple(e) for e in found[i]] == fold(x) for i, x in enumerate(lists)) and found[len(lists)] is None
    start = time.monotonic()
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("v"), i.cast("string"), F.when(i % 3 == 0, " slower").otherwise(""))).alias("items"))
    k = long.select(render.setting_keys(F.col("items")).alias("k")).select(F.size("k"), F.col("k")[2]["key"], F.element_at("k", -1)["key"]).first()
    assert tuple(k) == (66_668, "speech_rate", "setting_66667") and time.monotonic() - start < 60
