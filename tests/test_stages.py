"""Replies, staged extraction, tokenizers, renderers, contexts and control."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loresmith import settings
from loresmith.functions import replies, tokenizers
from loresmith.operators import merge, render, resolve, stages
from loresmith.sources import shared, state
from loresmith.streaming import control


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


def practices(spark, text):
    return [r.asDict() for r in one(spark, lambda c: replies.practices(c, F.lit("forum")), text)]


def test_replies_are_cleaned(spark):
    clean = lambda t: one(spark, replies.clean, t)
    assert clean('  Here is the JSON: {"a": 1}\n\nI hope this helps!') == '{"a": 1}'
    assert clean("```json\n[1, 2]\n``` and more") == "[1, 2]"
    assert clean('json: json: so {"a": [1]} it is') == '{"a": [1]}'
    assert clean("no brackets") == "no brackets" and clean("") == "" and clean(None) is None


def test_practices_of_replies(spark):
    row = {"practice_type": "tip", "content": "c", "model_name": "m", "confidence": 1, "source": "s"}
    full = row | {"confidence": 1.0, "category": "general"}
    assert practices(spark, json.dumps({"practices": [row, {"content": "no type"}]})) == [full]
    assert practices(spark, "JSON: see [] or\n```json\n" + json.dumps([row]) + "\n```") == [full]
    long = "you should avoid " + "x" * 300
    assert [(p["content"], p["confidence"], p["source"]) for p in practices(spark, long)] == [(long[:200] + "...", 0.3, "forum")]
    assert practices(spark, "nothing to see") == [] and practices(spark, "[]") == [] and practices(spark, "5") == []


def test_entities_of_replies(spark):
    e = one(spark, replies.entities, 'So: ```json {"models_mentioned": ["m"], "is_ai_related": true, "relevance_score": 0.9}```')
    assert e["models_mentioned"] == ["m"] and e["theme"] == "general" and e["relevance_score"] == 0.9
    bad = one(spark, replies.entities, "not JSON")
    assert bad["is_ai_related"] and bad["relevance_score"] == 0.3 and bad["summary"]
    assert not one(spark, replies.entities, "{}")["is_ai_related"]


def test_items_by_shape(spark):
    reply = json.dumps([{"tip": "t", "model_or_service": "M", "type": "parameter"}, {"tip": "u"}, {"problem": "p", "solution": "s", "service_name": "S", "confidence": 0.9}, {"content": "c"}, {"other": 1}])
    got = one(spark, lambda c: replies.items(c, F.array(F.lit("own"), F.lit("x"))), reply)
    assert [(i["practice_type"], i["content"], i["applicable_models"], i["confidence"]) for i in got[:4]] == [
        ("parameter", "t", ["M"], 0.7), ("technique", "u", ["own"], 0.7), ("cost_optimization", "Problem: p\nSolution: s", ["S"], 0.9), ("tip", "c", ["own"], 0.5),
    ]
    assert len(got) == 5 and one(spark, lambda c: replies.items(c, F.array().cast("array<string>")), "{}") == []
    assert one(spark, lambda c: replies.items(c, F.array().cast("array<string>")), 'so [{"tip": "t"}].')[0]["applicable_models"] == ["general"]


def test_judgements(spark):
    assert one(spark, replies.judgement, '```json\n{"is_relevant": true, "quality_score": 0.8}\n```')["quality_score"] == 0.8
    assert one(spark, replies.judgement, "hm")["reason"] == "Failed to parse evaluation"


class Failing:
    def __call__(self, prompt):
        if "bad" in prompt:
            raise TimeoutError
        return "JSON: {\"p\": 1}"


def test_asking_gives_empty_objects_on_failure(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "good"), (3, None)], "id int, p string")
    assert {r["id"]: r["reply"] for r in stages.ask(df, "p", Failing).collect()} == {1: "{}", 2: '{"p": 1}', 3: None}


def keep(df):
    return df.cache()


def test_hierarchical(spark):
    text = "alpha works well. " * 40 + "\n\n# Next\n\n" + "beta is slow. " * 40
    docs = spark.createDataFrame([(1, text, "forum"), (2, "nothing", "forum")], "doc_id long, text string, source string")
    found, sure = stages.hierarchical(docs, lambda: stages.KeywordExtractor(("alpha", "beta")), keep, size=600, overlap=50, least=100)
    assert sorted((r["doc_id"], r["entity"], r["content"]) for r in found.collect()) == [(1, "alpha", "about alpha"), (1, "alpha", "shared"), (1, "beta", "about beta")]
    got = {(r["doc_id"], r["entity"]): r["confidence"] for r in sure.collect()}
    assert got[1, "overall"] == pytest.approx(0.3) and got[2, "overall"] == 0.0 and got[1, "alpha"] == pytest.approx(0.6)


def test_adaptive_takes_each_way(spark):
    docs = spark.createDataFrame([(i, "alpha. " * n, "forum") for i, n in enumerate((10, 900, 3000))], "doc_id long, text string, source string")
    make = lambda: stages.KeywordExtractor(("alpha",))
    hosted = {r["doc_id"]: r for r in stages.adaptive(docs, "openrouter", "openai/gpt-4", make, keep).collect()}
    assert [hosted[i]["strategy"] for i in range(3)] == ["single_pass", "multi_chunk", "summary_first"]
    assert [hosted[i]["service_count"] for i in range(3)] == [1, 1, 1] and hosted[1]["practice_count"] == 2 and hosted[0]["extraction_confidence"] == 0.3
    own = {r["doc_id"]: r for r in stages.adaptive(docs, "local", "x", make, keep).collect()}
    assert own[2]["strategy"] == "extract_key_only" and own[2]["services"][0]["name"] == "alpha" and own[2]["practice_count"] == 0
    broken = stages.adaptive(docs, "local", "x", lambda: lambda prompt: "no", keep).collect()
    assert all(r["error"] == "extraction_failed" and r["services"] == [] for r in broken)


PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer file")
def test_tokens_by_a_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ["a few words", "", None, "naïve café " * 50, "x" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = {r["i"]: r for r in df.select("i", tokenizers.token_count(F.col("c"), PATH).alias("n"), tokenizers.truncate_tokens(F.col("c"), 40, PATH).alias("cut")).collect()}
    size = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    for i, text in enumerate(texts):
        assert got[i]["n"] == size(text or "")
        if text is None or size(text) <= 40:
            assert got[i]["cut"] == text
        else:
            head = got[i]["cut"].removesuffix("\n\n[Content truncated...]")
            assert head != got[i]["cut"] and text.startswith(head) and size(head) <= 40
            assert all(size(text[: len(head) + k]) > 40 for k in (1, 2, 3))
    plain = df.select("i", tokenizers.token_count(F.col("c")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in plain} == {i: len(x or "") // 4 for i, x in enumerate(texts)}


def test_renderers(spark):
    html = one(spark, render.markdown_html, "# T <b>\n\n```py\nx = *1* < 2\n\ny\n```\n\n*e* and `**f** <i>`\n\n* a\n- b\n\nplain & [l](http://x.org/a)\nline `open\n\n```\nnever ends")
    assert html == (
        "<h1>T &lt;b&gt;</h1>\n<pre><code>x = *1* &lt; 2\n\ny\n</code></pre>\n<p><em>e</em> and <code>**f** &lt;i&gt;</code></p>\n<ul><li>a</li>\n<li>b</li></ul>\n"
        '<p>plain &amp; <a href="http://x.org/a" target="_blank" rel="noopener">l</a><br/>line `open</p>\n<p>```<br/>never ends</p>'
    )
    assert one(spark, render.json_html, "{broken <") == '<pre class="code-block">{broken &lt;</pre>'
    span = lambda kind, s: f'<span class="json-{kind}">{s}</span>'
    assert one(spark, render.json_html, '{"a": [1, "b: 2 <", null]}') == (
        f'<pre class="code-block json">{{\n  {span("key", chr(34) + "a" + chr(34))}: [\n    {span("number", 1)},\n    {span("string", chr(34) + "b: 2 &lt;" + chr(34))},\n    {span("null", "null")}\n  ]\n}}</pre>'
    )
    card = one(spark, lambda c: render.practice_card(F.lit("M"), c), '{"parameters": [], "pitfalls": [{"title": "t", "description": "d"}]}')
    assert card == "# M Best Practices\n\n## Common Pitfalls\n\n### t\nd\n\n"


def test_variations_with_a_registry(spark):
    static = spark.createDataFrame([(0, "luma", "Luma AI"), (1, "luma", "luma")], "ord int, canonical string, variation string")
    registry = spark.createDataFrame([(0, "x1", "LUMA-ai"), (1, "nova", "Nova X")], "ord int, key string, display_name string")
    got = {r["canonical"]: r["variations"] for r in resolve.all_variations(static, registry).collect()}
    assert got == {"luma": ["LUMA-ai", "Luma AI", "luma"], "nova": ["Nova X", "nova", "nova x"]}
    asked = spark.createDataFrame([("luma ai",), ("zzz",)], "query string")
    assert {r["query"]: r["variations"] for r in resolve.variations_of(asked, static).collect()} == {"luma ai": ["Luma AI", "luma"], "zzz": ["zzz"]}


def test_content_hash_tells_lists_apart(spark):
    kind = "service_key string, problems array<string>, tips array<string>, cost_info array<string>, settings array<string>"
    rows = [("a", ["x|y"], [], [], []), ("b", ["x", "y"], [], [], []), ("c", ["y", "x"], [], [], []), ("d", [], [], [], ['say "hi"'])]
    got = {r["service_key"]: r["content_hash"] for r in merge.content_hash(spark.createDataFrame(rows, kind)).collect()}
    import hashlib

    plain = lambda r: hashlib.md5(json.dumps({k: sorted(v) for k, v in zip(("problems", "tips", "cost_info", "settings"), r[1:], strict=True)}, sort_keys=True).encode()).hexdigest()
    assert got == {r[0]: plain(r) for r in rows} and got["a"] != got["b"] == got["c"]


def test_white_space_and_solutions(spark):
    items = spark.createDataFrame([("g", "x\n", 1), ("g", "\tX", 2), ("g", "y", 3)], "g string, i string, o int")
    assert sorted(r["i"] for r in merge.dedup_ordered(items, ["g"], "i", "o").collect()) == ["x\n", "y"]
    rows = spark.createDataFrame([("P", 2, ["b"], 1), ("p", 1, ["a", "b"], 2)], "t string, id int, s array<string>, o int")
    got = merge.merge_ids(rows, "t", "o", "id", ("s",)).first()
    assert (got["t"], got["ids"], got["s"]) == ("P", [1, 2], ["a", "b"])


def test_contexts_and_cleanup(spark):
    def down():
        raise OSError

    assert state.fetch_contexts(spark, down).count() == 0 and state.hub_services(spark).count() == 0
    root = shared.folder(spark, "t")
    for n in ("a.tmp", "b.json"):
        shared.write_text(spark, f"{root}/{n}", "x")
    assert len(state.cleanup(spark, [f"{root}/*.tmp"])) == 1 == len(state.cleanup(spark, [f"{root}/*.tmp"], dry_run=False))
    assert [p.rsplit("/", 1)[1] for p in state.cleanup(spark, [f"{root}/*"])] == ["b.json"]


def test_control():
    now, made = [0.0], []
    value = control.Expiring(lambda: made.append(1) or len(made), 60, lambda: now[0])
    assert (value(), value()) == (1, 1)
    now[0] = 61.0
    assert value() == 2
    value.forget()
    assert value() == 3

    def fails():
        raise ValueError("no")

    got = list(control.run_bounded([lambda i=i: i for i in range(9)] + [fails], 2))
    assert [r for r, _ in got[:9]] == list(range(9)) and isinstance(got[9][1], ValueError)


def test_progress_is_told(spark, tmp_path):
    seen = []
    listener = control.Progress(lambda total, last: seen.append((total, last)))
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(50):
            if seen and seen[-1][0] == 5:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert seen and seen[-1][0] == 5


def test_credentials():
    s = settings.Settings()
    assert not settings.has_credentials(s, "openrouter") and settings.has_credentials(s, "github", {"GITHUB_TOKEN": "t"}) and not settings.has_credentials(s, "reddit", {"REDDIT_CLIENT_ID": "x"})
