"""Folds in order over many tasks, against the plain fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loresmith import api
from loresmith.operators import ordered, pack, registry

@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges are not joined to one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


POSTS = "service string, post_id long, content string, cost long"


def plain(rows, usable, base):
    out = []
    for k in {r[0] for r in rows}:
        own = [{"post_id": i, "content": c or "", "cost": n} for s, i, c, n in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        out += [(k, n, x["post_id"], x["content"]) for n, batch in enumerate(pack.pack_posts(own, usable, base)) for x in batch]
    return sorted(out, key=str)


@pytest.mark.parametrize(("usable", "base"), [(400, 100), (310, 50), (90, 100)])
def test_pointers_are_the_fold(spark, monkeypatch, usable, base):
    rnd = random.Random(usable)
    rows = []
    for k, n in (("a", 300), ("b", 40), (None, 25), ("c", 1)):
        for i in range(n):
            cost = rnd.choice([0, 0, 1, 5, 40, 120, 299, 300, 301, 900])
            rows.append((k, i, rnd.choice([None, "", "One. Two. " * 60, "x" * 30, "Long sentence here. " * rnd.randint(1, 120)]), cost))
    rows += [("zero", i, "z", 0) for i in range(30)]
    df = spark.createDataFrame(rows, POSTS)
    want = plain(rows, usable, base)
    run = lambda: sorted((tuple(r) for r in pack.pack_batches(df, key="service", order="post_id", usable=usable, base=base).drop("n_chars").collect()), key=str)
    assert run() == want
    for hot, many in ((0, 100), (100, 100), (0, 1)):  # all keys by pointers, one of them, and more than are named
        monkeypatch.setattr(pack, "HOT", hot)
        monkeypatch.setattr(pack, "MANY", many)
        assert run() == want
    assert pack.pack_batches(df.where("false"), key="service", order="post_id", usable=usable, base=base).count() == 0


class Echo:
    """What it was asked, as tips."""

    def __call__(self, prompt):
        import json

        posts = json.loads(re.search(r"^Posts: (.*)$", prompt, re.M)[1])
        return json.dumps({"tips": [f"{p['id']}|{p['title']}|{p['content']}" for p in posts], "problems": [str(len(prompt))]})


def test_divided_posts_are_asked_in_their_parts(spark):
    """No prompt holds more than the budget, and every sentence is asked once."""
    long = ". ".join(f"Sentence {i} of the long post with words" for i in range(480)) + "."
    rows = [("s", 1, "t1", "short"), ("s", 2, "t2", long), ("s", 3, None, None), ("t", 1, "t3", "other"), (None, 9, "n", "none")]
    out = api.run_extraction(spark.createDataFrame(rows, "service string, post_id long, title string, content string"), Echo, usable=2396, base=400).collect()
    asked = [t.split("|", 2) for r in out if r["service"] == "s" for t in r["tips"]]
    assert all(int(r["problems"][0]) // 4 <= 2396 for r in out) and sum(a[0] == "2" for a in asked) > 2
    text = " ".join(a[2] for a in sorted((a for a in asked if a[0] == "2"), key=lambda a: int(re.search(r"\d+", a[2])[0])))
    assert re.findall(r"Sentence (\d+)", text) == [str(i) for i in range(480)]
    assert sorted((a[0], a[1]) for a in asked if a[0] != "2") == [("1", "t1"), ("3", "")] and {r["service"] for r in out} == {"s", "t"}


def plain_registry(rows):
    known, out, seen = {}, [], set()
    for _, name in sorted(r for r in rows if r[1] is not None):
        low = name.lower()
        if low in seen:
            continue
        seen.add(low)
        c = known.get(low)
        if c is None:
            c = re.sub("[^a-z0-9]", "", re.sub(r"\s*(ai|api|platform|tool|app|\.ai|\.io|\.com)$", "", low))
            known.setdefault(low, c)
            known.setdefault(c, c)
        out.append((low, c))
    return sorted(out)


def test_registry_in_order_is_the_fold(spark):
    rnd = random.Random(8)
    tails = ["", "ai", " ai", "api", " API", "tool", "app", ".io", " platform"]
    made = ["".join([rnd.choice(["x", "Open", "zap"]), *rnd.choices(tails, k=rnd.randint(0, 4))]) for _ in range(400)]
    rows = [*enumerate(made), (1000, None), (1001, "openaiapi"), (1002, "ai")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "ord long, name string")
    want = plain_registry(rows)
    assert sorted(map(tuple, registry.fold_in_order(df).collect())) == want
    assert any(low == c and re.search(r"(ai|api|tool|app)$", low) for low, c in want)  # some are fed back
    assert registry.fold_in_order(df.where("false")).count() == 0


def test_running_sums(spark, tmp_path):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rnd.randint(0, 9)) for i in range(2000)]
    seq = ordered.sequenced(spark, spark.createDataFrame(rows, "g string, o long, v long"), "g", ["o"], f"{tmp_path}/seq")
    got = {r["o"]: r["s"] for r in ordered.running(seq, "g", {"v": "s"}).collect()}
    total: dict = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + v
        assert got[o] == total[g]
    assert seq.select(F.count_distinct("_part")).first()[0] > 1
