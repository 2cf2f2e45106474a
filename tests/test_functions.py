import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loresmith.functions import lookups, names, text
from loresmith.operators import extract, pack, registry, render, resolve, search


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_alias_spellings(spark):
    """The spellings of one service resolve alike; unknown ones stay unknown."""
    cases = {"Eleven Labs": "elevenlabs", "eleven-labs": "elevenlabs", "ElevenLabs": "elevenlabs", "Hey Gen": "heygen", "character.ai": "characterai", "Copilot": "githubcopilot", "HF": "huggingface", "zzqx": None}
    df = spark.createDataFrame([(n,) for n in cases], "name string")
    got = {r["name"]: r["canonical"] for r in resolve.resolve(df, "name", lookups.variations(spark)).collect()}
    assert got == cases


def test_alias_map_registry_wins_and_matches(spark):
    static = lookups.variations(spark)
    reg = spark.createDataFrame([(0, "mylab", "My Lab"), (1, "el", "Eleven Labs")], "ord int, key string, display_name string")
    m = {r["alias"]: r["canonical"] for r in resolve.alias_map(static, reg).collect()}
    assert m["my lab"] == m["mylab"] == "mylab" and m["el"] == "elevenlabs"


def test_categories(spark):
    assert one(spark, names.category(F.col("a"), F.col("b")), a="Runway", b="x") == "video"
    assert one(spark, names.category(F.col("a"), F.col("b")), a="Zed", b="a text-to-image llm") == "image"
    assert one(spark, names.category(F.col("a"), F.col("b")), a="Zed", b="an llm") == "text"
    assert one(spark, names.is_service(F.col("a"), F.col("u"), F.col("b")), a="A very long title of six words", u="", b="api") is False
    assert one(spark, names.is_service(F.col("a"), F.col("u"), F.col("b")), a="Zed", u="https://zed.ai", b="x") is True


def test_similarity_edges(spark):
    s = lambda a, b: one(spark, names.similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert s("GPT-4", "gpt4") == 1 and s("code", "Qwen3-Coder") == 0.8 and s("", "x") == 0.8 and s("", "-") == 1
    assert abs(s("abcd", "abxy") - 0.5) < 1e-9


def test_fuzzy_blocking_is_exact(spark):
    entries = spark.createDataFrame([(i, n, "c") for i, n in enumerate(["alpha", "alphabet soup", "beta-max", "gamma", "a", "longer name here"])], "ord int, name string, category string")
    asked = spark.createDataFrame([("alpha",), ("betamx",), ("",), ("gama",)], "query string")
    plain = entries.crossJoin(asked).select("query", "name", F.round(names.similarity(F.col("query"), F.col("name")), 6).alias("s")).where("s >= 0.3")
    got = search.fuzzy_matches(asked, entries).select("query", "name", F.col("similarity").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_json_replies(spark):
    for reply, want in (('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('so {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ("none", None)):
        assert one(spark, text.json_object(F.col("r")), r=reply) == want
    assert one(spark, text.json_array(F.col("r")), r='see ["x"] ok') == '["x"]' and one(spark, text.json_array(F.col("r")), r="none") == "[]"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=30), st.integers(300, 500))
def test_packing_fits_and_keeps_order(costs, usable):
    posts = [{"post_id": i, "content": "a. b. c", "cost": c} for i, c in enumerate(costs)]
    batches = list(pack.pack_posts(posts, usable, 50))
    ids = [p["post_id"] for b in batches for p in b]
    assert ids == sorted(ids) and set(ids) == set(range(len(costs)))
    assert all(sum(p["cost"] for p in b) <= usable - 50 or len(b) == 1 for b in batches)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab. !?\n#-", max_size=300), st.integers(5, 60))
def test_chunks_cover(t, size):
    assert "".join(pack.boundary_chunks(t, size) or [t]) == t
    assert "\n\n".join(pack.section_chunks(t, size)).replace("\n", "") == t.replace("\n", "")
    joined = pack.sentence_chunks(t, size)
    assert joined and all(isinstance(x, str) for x in joined)


def test_overlap_chunks_example(spark):
    """A tail under the least size joins the chunk before; the formula's total stays one too high."""
    df = spark.createDataFrame([("x" * 15900,)], "t string").select(F.explode(text.overlap_chunks(F.col("t"))).alias("c")).select("c.*")
    got = [(r["start_pos"], r["end_pos"], r["total_chunks"], r["overlap_with_next"]) for r in df.collect()]
    assert got == [(0, 8000, 3, 500), (7500, 15900, 3, 500)]


def test_registry_feedback(spark):
    """A later name that is an earlier canonical name keeps it."""
    s = spark.createDataFrame([(0, "XAPI AI"), (1, "xapi"), (2, "Foo API")], "ord int, name string")
    got = {r["low"]: r["canonical_name"] for r in registry.fold_in_order(s).collect()}
    assert got == {"xapi ai": "xapi", "xapi": "xapi", "foo api": "foo"}


def test_setting_and_cost_keys(spark):
    df = spark.createDataFrame([(["use break tag", "a", "slower please", "b"], ["t1", "$5", "t2", "$6", "unlimited x"])], "s array<string>, c array<string>")
    r = json.loads(df.select(render.parameters(F.lit("X"), F.col("s"), F.col("c"), "2024-01-01").alias("j")).first()["j"])
    assert list(r["recommended_settings"]) == ["speech_pauses", "setting_1", "speech_rate", "setting_3"]
    assert r["cost_optimization"] == {"tip_0": "t1", "pricing": "$6", "tip_2": "t2", "unlimited_option": "unlimited x"}


def test_golden_prompting(spark):
    df = spark.createDataFrame([("Zed", ["one", "two"], ["k=v"])], "n string, t array<string>, s array<string>")
    got = df.select(render.prompting(F.col("n"), F.col("t"), F.col("s"), "2025-08-12").alias("x")).first()["x"]
    assert got == (
        "# Zed Prompting Guide\n\n*Last updated: 2025-08-12*\n\n## Tips & Techniques\n\n- one\n- two\n\n## Recommended Settings\n\n- k=v\n\n"
        "## Sources\n\n- Reddit community discussions\n- User-reported experiences\n"
    )


def test_extractor(spark):
    b = spark.createDataFrame([("Zed", 0, [(1, "t", "It costs $5 a month. Set temperature = 0.7 now. It crashes often. You should use v2."), (2, "u", "")])], "service string, batch int, posts array<struct<post_id:long,title:string,content:string>>")
    r = extract.extract(b, extract.RuleExtractor).first()
    assert r["cost_info"] == ["It costs $5 a month."] and r["settings"] == ["Set temperature = 0.7 now."] and r["problems"] == ["It crashes often."] and r["tips"] == ["You should use v2."] and r["error"] is None
    halves = extract.ask(extract.RuleExtractor(), "Z", [{"post_id": i, "title": "", "content": "You should use x."} for i in range(4)], 60)
    assert halves["tips"] == ["You should use x."]
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "{}"

    assert extract.Retrying(flaky, sleep=lambda s: None)("p") == "{}" and len(calls) == 3
    assert extract.ask(lambda p: "no", "Z", [{"post_id": 1}], None)["error"]
    assert extract.reply_json('x ```json\n{"a": 1}\n```') == {"a": 1} and extract.as_items([{"k": 1}, "x"]) == ["k = 1", "x"]


def test_mentions_is_substring(spark):
    d = spark.createDataFrame([(1, "I did it with hf"), (2, "nothing")], "id long, t string")
    got = sorted((r["id"], r["canonical"]) for r in resolve.mentions(d, "t", [(c, v) for c, vs in lookups.VARIATIONS for v in vs]).select("id", "canonical").collect())
    assert got == [(1, "did"), (1, "huggingface")]


def test_relevant_section_of_every_document(spark):
    """The five patterns by brute force; each decides at least one document."""
    import re

    texts = ["so\nBest practices: a\n\nb\n\ntip: c", "x Tips : one\n\ny\n\ntip: two\n\ntip: 3\n\ntip: 4", "we recommend this\n\nparameter", "Parameters are\n\nend", "a prompt\nof two lines", "nothing", "", None]
    patterns = ["best practices?", r"tips?\s*:", "recommend", "parameters?", "prompt"]

    def section(t):
        found = (re.findall(rf"{p}.*?(?:\n\n|\Z)", t, re.I | re.S) for p in patterns)
        return next((" ".join(f[:3]) for f in found if f), t)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", text.relevant_section(F.col("text")).alias("s")).collect()}
    assert got == {i: None if t is None else section(t) for i, t in enumerate(texts)}
