import json

import pytest
from pyspark.sql import functions as F

from loresmith import api, settings
from loresmith.functions import lookups
from loresmith.operators import extract, merge, render
from loresmith.sources import entry_sink, state, tables


@pytest.fixture(scope="module")
def base(spark):
    posts = spark.createDataFrame(
        [("Runway", 1, "t", "It costs $5 a month. You should use v2. It crashes often."), ("runway", 2, "u", "Set seed = 7 now. You should use v2."), ("Cursor", 3, "v", "Free tier limit is 10.")],
        "service string, post_id long, title string, content string",
    )
    results = api.run_extraction(posts, extract.RuleExtractor).cache()
    return api.KnowledgeBase(spark, api.build_tree(results, "2025-08-12").cache())


def test_from_posts_to_answers(base):
    assert [tuple(r) for r in base.list_entries().collect()] == [("code", "cursor"), ("video", "runway")]
    got = {r["file"]: r["content"] for r in base.best_practices("Run-way").collect()}
    assert "- You should use v2." in got["prompting.md"] and "- Pricing: It costs $5 a month." in got["parameters.json"] and "crashes" in got["pitfalls.md"]
    assert [r["name"] for r in base.search("runwy").collect()][0] == "runway"
    assert [r["name"] for r in base.find("curs").collect()] == ["cursor"]
    assert [r["name"] for r in base.recommend("video_generation").collect()] == ["runway"]
    assert {r["category"]: r["n"] for r in base.counts().collect()} == {"code": 1, "video": 1, None: 2}
    assert base.suggest("cursr").first()["name"] == "cursor" and base.info("code", "cursor").count() >= 2
    with pytest.raises(ValueError):
        base.recommend("x")


def test_exports(base):
    import yaml

    j = {r["category"]: json.loads(r["content"]) for r in base.export().collect()}
    assert set(j) == {"code", "video"} and "metadata.json" in j["code"]["cursor"]
    y = yaml.safe_load(base.export("yaml", category="code").first()["content"])
    assert "cursor/metadata.json" in y and json.loads(y["cursor/metadata.json"][0])["posts_analyzed"] == 1
    assert base.export("markdown", model="runway").first()["content"].startswith("# video\n\n## runway / ")
    assert base.manifest().count() == 2 and base.findings("2025-08-13").where("severity = 'error' and rule != 'missing_file'").count() == 0


def test_trees_round_trip(spark, base, tmp_path):
    want = sorted(tuple(r) for r in base.tree.select("category", "slug", "file", "content").collect())
    render.write_files(base.tree, str(tmp_path / "wide"))
    assert sorted(tuple(r) for r in render.read_files(spark, str(tmp_path / "wide")).collect()) == want
    for _ in range(2):  # a second version takes the first one's place
        assert sorted(tuple(r)[:4] for r in render.publish(base.tree, str(tmp_path / "models")).collect()) == want
    assert sorted(tuple(r)[:4] for r in tables.corpus(spark, entry_sink.current(str(tmp_path / "models"))).collect()) == want
    assert entry_sink.discard_old(str(tmp_path / "models")) == 1
    names = {p.relative_to(entry_sink.current(str(tmp_path / "models"))).as_posix() for p in (tmp_path / "models").rglob("*.*") if p.is_file() and p.name[0] != "."}
    assert names == {f"{c}/{s}/{f}" for c, s, f, _ in want}
    bad = base.tree.select("category", "slug", "file", "content").unionByName(spark.createDataFrame([("code", "..", "x.md", "c")], "category string, slug string, file string, content string"))
    before = entry_sink.current(str(tmp_path / "models"))
    with pytest.raises(Exception, match="not a name"):
        render.publish(bad, str(tmp_path / "models"))
    assert entry_sink.current(str(tmp_path / "models")) == before and len([p for p in (tmp_path / "models").iterdir() if p.is_dir()]) == 1


def test_written_files_have_their_own_names(spark, tmp_path):
    rows = [("code", "cursor", "a.md", "x\n"), ("code", "o/d d", "_b.md", ""), ("code", "..", "é%.md", "y"), ("code", "null", "c.md", "z"), (None, "%null", "d.md", "w")]
    render.write_files(spark.createDataFrame([("old", "old", "old.md", "old")], "category string, slug string, file string, content string"), str(tmp_path / "t"))
    render.write_files(spark.createDataFrame(rows, "category string, slug string, file string, content string"), str(tmp_path / "t"))
    assert {tuple(r) for r in render.read_files(spark, str(tmp_path / "t")).collect()} == set(rows)
    assert sum(f.is_file() for f in (tmp_path / "t").rglob("*.md")) == 5
    assert [f.read_text() for f in (tmp_path / "t").glob("*/code/cursor/a.md")] == ["x\n"]


def test_parameter_arrays(spark):
    p = '[{"name": "t", "default_value": 0.7, "recommended_range": "0-1", "description": "d"}]'
    df = spark.createDataFrame([(p,)], "p string")
    assert df.select(api.format_parameters(F.col("p")).alias("x")).first()["x"] == "### t\n- Default: 0.7\n- Recommended: 0-1\n- d\n"


def test_settings():
    s = settings.load({"LOG_LEVEL": "debug", "API_PORT": "9000", "LLM_PROCESSING_ENABLED": "false", "LOCAL_LLM_MAX_CONTEXT": "8192"})
    assert (s.log_level, s.api_port, s.llm_processing_enabled, s.context, s.timeout) == ("DEBUG", 9000, False, (8192, 2048), 120.0)
    for bad in ({"LOG_LEVEL": "x"}, {"LLM_QUALITY_THRESHOLD": "2"}, {"LLM_PROVIDER": "openrouter"}, {"API_PORT": "0"}):
        with pytest.raises(ValueError):
            settings.load(bad)


def test_state_files(spark, tmp_path):
    results = {"results": [{"service": "Zed", "tips": ["a", "A"], "setttings": ["k=v"], "batch_size": 3, "timestamp": "t"}, {"service": "zed", "tips": ["b"], "batch_size": 2}, {"service": "Bee", "batch_size": 1}]}
    (tmp_path / "batch_results_1.json").write_text(json.dumps(results))
    m = {r["service_key"]: r for r in merge.merge_by_service(state.extraction_results(spark, str(tmp_path / "batch_results_1.json"))).collect()}
    assert m["zed"]["service"] == "Zed" and m["zed"]["batch_size"] == 5 and m["zed"]["tips"] == ["A", "a", "b"] and m["zed"]["settings"] == ["k=v"] and m["bee"]["batch_size"] == 1
    assert state.latest_file(spark, str(tmp_path)).endswith("batch_results_1.json")
    (tmp_path / "ctx.json").write_text(json.dumps({"models": {"a/b": {"context_length": 9, "pricing": {"prompt": "0"}}, "c": {}}}))
    assert {r["model_id"]: r["context_length"] for r in state.model_contexts(spark, str(tmp_path / "ctx.json")).collect()} == {"a/b": 9, "c": 4096}
    assert state.update_log(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "log.json").write_text(json.dumps({"services": {"zed": {"timestamp": "2024-01-02T00:00:00", "content_counts": {"tips": 2, "problems": 1}}}}))
    assert state.update_log(spark, str(tmp_path / "log.json")).first()["total"] == 3


def test_sources(spark):
    text = """
reddit:
  sources:
    - {name: r/LocalLLaMA, url: "https://reddit.com/r/LocalLLaMA", priority: high, models: [llama]}
    - {name: r/x, url: "https://reddit.com/r/x", priority: low, models: [general]}
github:
  sources:
    - {name: awesome, url: "https://github.com/a/b/", priority: high}
"""
    s = tables.source_config(spark, text)
    assert state.default_sources(s) == ["reddit:LocalLLaMA", "github:a/b"] and state.default_sources(s.limit(0)) == ["reddit:LocalLLaMA", "reddit:OpenAI"]
    assert state.for_model(s, "llama").count() == 3 and state.for_model(s, "gpt").count() == 2 and state.by_priority(s, "low").count() == 1
    assert state.dispatch(["reddit:a", "github:b/c", "hackernews:x"]) == (["a"], ["b/c"])
    changed = spark.createDataFrame([("video/a",), ("video/b",), ("video/a",)], "entity string")
    assert state.commit_message(changed, "2025-01-01").startswith("docs: Update video/a, video/b documentation\n")
    assert state.commit_message(changed.limit(0), "2025-01-01") == "docs: Update service documentation"
    readme = state.repo_readme(spark.createDataFrame([("guide", "x" * 4000), ("a/b", "y")], "repo string, content string")).collect()
    assert readme[0]["repo"] == "dair-ai/guide" and len(readme[0]["content"]) == 3000


def test_discover_registry(spark):
    lists = spark.createDataFrame([("l", "- [Zed AI](https://zed.ai) - an image api\n- [zed](https://zed.ai) - image api and longer text\n")], "source string, content string")
    r = api.discover(lists).first()
    assert (r["canonical_name"], r["display_name"], r["description"]) == ("zed", "Zed AI", "image api and longer text")
    j = state.registry_json(api.discover(lists), "now").first()
    assert j["services"]["zed"]["category"] == "image" and j["aliases"]["zed ai"] == "zed"


def test_run_report(spark):
    df = spark.createDataFrame([("a", 2, None), ("b", 1, "x")], "service string, batch_size int, error string")
    r = state.run_report(df, "now").first()
    assert (r["queries_run"], r["successful_queries"], r["failed_queries"], r["total_posts_scraped"], len(r["results"])) == (2, 1, 1, 3, 2)


def test_priority_names_are_fixed():
    assert len(lookups.PRIORITY_NAMES) == 50 and len(lookups.VARIATIONS) == 31
