"""Queries on replies and on extraction in stages, with the offline keyword extractor."""

from __future__ import annotations

from pyspark.sql import functions as F

from loresmith.functions import replies
from loresmith.operators import merge, stages
from loresmith.plans import sql as S
from loresmith.plans.catalogue import query
from loresmith.sources import shared, tables

#: Names that invented texts hold often enough.
NAMES = ("that", "tion", "License", "elle", "heit", "ción", "unless", "ment")


def _make():
    return stages.KeywordExtractor(NAMES)


def _keep(spark):
    def keep(df):
        path = shared.folder(spark, "stage")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def _docs(spark, d):
    return tables.table(spark, d, "documents")


# --- replies, shaped by the length of each document

_OBJECT = """'{"practices": [{"practice_type": "tip", "content": "use ' || source || '", "model_name": "' || lang || '", "confidence": 0.5, "source": "s"}, {"practice_type": "tip"}]}'"""
_LIST = """'[{"practice_type": "parameter", "content": "set ' || lang || '", "model_name": "m", "confidence": 0.75, "source": "s", "category": "c"}]'"""
_REPLY = f"""CASE n_chars % 7 WHEN 0 THEN {_OBJECT} WHEN 1 THEN '  here is the json: ' || {_OBJECT} || chr(10) || chr(10) || 'I hope this helps! [1]' WHEN 2 THEN 'Sure.' || chr(10) || '```json' || chr(10) || {_LIST} || chr(10) || '```'
  WHEN 3 THEN 'no JSON, but ' || substr(text, 1, 300) || ' avoid it' WHEN 4 THEN 'Here''s the JSON: JSON: {{broken' WHEN 5 THEN '```' || {_LIST} || '```' ELSE 'I see ' || {_LIST} || ' there' END"""


def _replies(spark, d):
    c, lit, n = F.concat, F.lit, F.col("n_chars") % 7
    obj = c(lit('{"practices": [{"practice_type": "tip", "content": "use '), "source", lit('", "model_name": "'), "lang", lit('", "confidence": 0.5, "source": "s"}, {"practice_type": "tip"}]}'))
    arr = c(lit('[{"practice_type": "parameter", "content": "set '), "lang", lit('", "model_name": "m", "confidence": 0.75, "source": "s", "category": "c"}]'))
    reply = (
        F.when(n == 0, obj).when(n == 1, c(lit("  here is the json: "), obj, lit("\n\nI hope this helps! [1]"))).when(n == 2, c(lit("Sure.\n```json\n"), arr, lit("\n```")))
        .when(n == 3, c(lit("no JSON, but "), F.substring("text", 1, 300), lit(" avoid it"))).when(n == 4, lit("Here's the JSON: JSON: {broken")).when(n == 5, c(lit("```"), arr, lit("```"))).otherwise(c(lit("I see "), arr, lit(" there")))
    )
    return _docs(spark, d).select("doc_id", "lang", "source", reply.alias("reply"))


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _clean() -> str:
    c = _strip("reply")
    for p in replies.PREFIXES:
        c = _strip(f"regexp_replace({c}, {S.quoted('(?i)^' + p.replace('.', chr(92) + '.'))}, '')")
    for s in replies.SUFFIXES:
        c = _strip(f"split_part({c}, {S.quoted(s)}, 1)")
    return c


_R = f"r AS (SELECT doc_id, lang, source, {_REPLY.replace('{{broken', '{broken')} AS reply FROM documents)"


@query("reply_clean", rf"WITH {_R}, c AS (SELECT doc_id, {_clean()} AS c FROM r) SELECT doc_id, CASE WHEN c = '' OR regexp_matches(c, '^[\[{{]') OR regexp_extract(c, '(?s)[\[{{].*[\]}}]') = '' THEN c ELSE regexp_extract(c, '(?s)[\[{{].*[\]}}]') END AS reply FROM c")
def reply_clean(spark, d):
    return _replies(spark, d).select("doc_id", replies.clean(F.col("reply")).alias("reply"))


@query(
    "reply_practices",
    f"""WITH {_R} SELECT doc_id, 'tip' AS practice_type, 'use ' || source AS content, lang AS model_name, 0.5::DOUBLE AS confidence, 's' AS source, 'general' AS category FROM r WHERE contains(reply, '"practices"')
    UNION ALL SELECT doc_id, 'parameter', 'set ' || lang, 'm', 0.75, 's', 'c' FROM r WHERE contains(reply, '"parameter"')
    UNION ALL SELECT doc_id, 'tip', CASE WHEN length(reply) > 200 THEN substr(reply, 1, 200) || '...' ELSE reply END, 'general', 0.3, source, 'general' FROM r WHERE NOT contains(reply, '[{{') AND regexp_matches(lower(reply), '{"|".join(replies.FALLBACK_WORDS)}')""",
)
def reply_practices(spark, d):
    p = replies.practices(F.col("reply"), F.col("source"))
    return _replies(spark, d).select("doc_id", F.explode(p).alias("p")).select("doc_id", "p.*")


_HITS = "list_filter([" + ", ".join(S.quoted(n) for n in NAMES) + "], lambda n: contains(substr(text, 1, {head}), n))"
_FOUND = f"e AS (SELECT doc_id, source, text, {_HITS.format(head=stages.ENTITY_HEAD)} AS m FROM documents)"


def _entities(spark, d):
    return stages.entities(_docs(spark, d).select("doc_id", "source", "text"), "text", "source", _make)


@query("entity_extraction", f"WITH {_FOUND} SELECT doc_id, array_to_string(m, ',') AS models, CASE WHEN len(m) > 0 THEN 'tools' ELSE 'general' END AS theme, len(m) > 0 AS is_ai_related, least(1.0::DOUBLE, len(m) / 4) AS relevance_score FROM e")
def entity_extraction(spark, d):
    return _entities(spark, d).select("doc_id", F.array_join("models_mentioned", ",").alias("models"), "theme", "is_ai_related", "relevance_score")


@query("relevance_gates", f"WITH {_FOUND} SELECT 'forum' AS kind, doc_id FROM e WHERE len(m) > 0 UNION ALL SELECT 'news', doc_id FROM e WHERE len(m) / 4 > 0.4 UNION ALL SELECT 'readme', doc_id FROM e WHERE len(m) / 4 > 0.3")
def relevance_gates(spark, d):
    found = _keep(spark)(_entities(spark, d).drop("text"))
    kinds = [stages.relevant(found, k).select(F.lit(k).alias("kind"), "doc_id") for k in ("forum", "news", "readme")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


_ITEMS = f"""{_FOUND}, body AS (SELECT doc_id, text, m, {_HITS.format(head=stages.PRACTICE_HEAD)} AS n FROM e WHERE len(m) / 4 >= 0.3),
  p AS (SELECT doc_id, text, 'technique' AS practice_type, 'use ' || unnest(n) AS content, unnest(n) AS model, 0.7::DOUBLE AS confidence FROM body
    UNION ALL SELECT doc_id, text, 'cost_optimization', 'Problem: slow' || chr(10) || 'Solution: wait', m[1], 0.5 FROM body)"""


def _practices(spark, d):
    found = _keep(spark)(stages.practices(_entities(spark, d), "text", _make))
    return found.select("doc_id", "text", F.explode("practices").alias("p")).select("doc_id", "text", "p.*")


@query("practice_extraction", f"WITH {_ITEMS} SELECT doc_id, practice_type, content, model, confidence FROM p")
def practice_extraction(spark, d):
    return _practices(spark, d).select("doc_id", "practice_type", "content", F.array_join("applicable_models", ",").alias("model"), "confidence")


@query(
    "practice_judgement",
    f"WITH {_ITEMS}, j AS (SELECT *, {_HITS.format(head=stages.CONTEXT_HEAD)} AS k FROM p) SELECT doc_id, practice_type, model, CASE WHEN len(k) > 2 THEN 'better' ELSE content END AS content, round(len(k) / 8, 3) AS quality_score, len(k) > 0 AS is_relevant FROM j",
)
def practice_judgement(spark, d):
    p = _practices(spark, d).withColumn("model", F.array_join("applicable_models", ","))
    return stages.judge(p, "model", "text", _make).select("doc_id", "practice_type", "model", "content", "quality_score", F.col("judgement.is_relevant").alias("is_relevant"))


@query(
    "enhanced_posts",
    f"""WITH top AS (SELECT doc_id, source, 'Title: ' || substr(split_part(text, chr(10), 1), 1, 300) || chr(10) || chr(10) || 'Content: ' || substr(text, 1, 500) AS text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5), t AS (SELECT *, {_HITS.format(head=8000)} AS m FROM top)
    SELECT doc_id AS post_id, CASE WHEN len(m) > 0 THEN len(m) || ' names' ELSE 'a setting' END AS content, CASE WHEN len(m) > 0 THEN m[1] ELSE 'general' END AS model_name, CASE WHEN len(m) > 0 THEN 0.5::DOUBLE ELSE 0.3 END AS confidence FROM t WHERE len(m) > 0 OR length(text) % 2 = 0""",
)
def enhanced_posts(spark, d):
    p = tables.posts(spark, d).withColumnRenamed("community", "source").withColumn("title", F.substring("title", 1, 300))
    return stages.enhance(p, [F.desc("score"), F.col("post_id")], _make).select("post_id", "content", "model_name", "confidence")


@query("hierarchical_practices")
def hierarchical_practices(spark, d):
    found, _ = stages.hierarchical(_docs(spark, d).select("doc_id", "text", "source"), _make, _keep(spark), size=2000, overlap=200, least=500)
    return found


@query("adaptive_processing")
def adaptive_processing(spark, d):
    """A hosted model, and a small one of one's own: all four ways are taken."""
    docs = _docs(spark, d).select("doc_id", "text", "source")
    out = [stages.adaptive(docs, p, m, _make, _keep(spark)).withColumn("model", F.lit(m)) for p, m in (("openrouter", "openai/gpt-4"), ("local", "own"))]
    return out[0].unionByName(out[1]).select("model", "doc_id", "strategy", F.to_json("services").alias("services"), F.array_join("insights", "|").alias("insights"), "overall_score", "extraction_confidence", "service_count", "practice_count", "error")


@query(
    "chunk_services",
    """WITH r AS (SELECT event_id AS ord, 's' || (user_id % 20) AS name, CASE WHEN event_type <> 'view' THEN event_type END AS type, CASE WHEN event_type = 'click' THEN props END AS p FROM events)
    SELECT name, arg_min(coalesce(type, 'unknown'), ord) AS type, count(p) AS n_practices, md5(string_agg(p, '|' ORDER BY ord)) AS practices_md5 FROM r GROUP BY name""",
)
def chunk_services(spark, d):
    e = tables.table(spark, d, "events")
    kind = F.col("event_type")
    rows = e.select(
        F.col("event_id").alias("ord"), F.lit(0).alias("chunk"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("name"), F.when(kind != "view", kind).alias("type"), F.when(kind == "click", F.array("props")).alias("practices"),
    )
    m = merge.merge_chunk_services(rows)
    return m.select("name", "type", F.size("practices").cast("long").alias("n_practices"), F.md5(F.array_join("practices", "|")).alias("practices_md5"))


_LISTS = (("prompt_patterns", "click"), ("parameter_recommendations", "view"), ("common_mistakes", "error"), ("examples", "signup"), ("tips", "purchase"))


@query(
    "categorised_practices",
    "SELECT user_id % 10 AS grp, " + ", ".join(f"md5(coalesce(string_agg(props, '|' ORDER BY event_id) FILTER (WHERE event_type = '{kind}'), '')) AS {name}" for (_, kind), (name, _) in zip(_LISTS, merge.CATEGORIES, strict=True)) + " FROM events GROUP BY 1",
)
def categorised_practices(spark, d):
    e = tables.table(spark, d, "events")
    posts = e.select((F.col("user_id") % 10).alias("grp"), "event_id", *(F.when(F.col("event_type") == kind, F.array("props")).alias(name) for name, kind in _LISTS))
    m = merge.categorise(posts, "grp", "event_id")
    return m.select("grp", *(F.md5(F.array_join(name, "|")).alias(name) for name, _ in merge.CATEGORIES))
