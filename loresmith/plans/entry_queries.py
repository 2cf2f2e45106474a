"""Queries on extractions, entries, search, updates, validation, documents and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loresmith.functions import lookups as L
from loresmith.functions import names, text
from loresmith.operators import counters, extract, incremental, merge, pack, render, search, validate
from loresmith.plans import sql as S
from loresmith.plans.catalogue import query
from loresmith.sources import shared, tables
from loresmith.streaming import polls, state

AS_OF = "2024-02-01 00:00:00"
DAY = "2024-02-01"

# --- merging

_MERGED = f"""{S.ITEMS}, heads AS (SELECT lower(service) AS service_key, arg_min(service, ord) AS service, arg_min(ts, ord) AS ts, CAST(sum(batch_size) AS BIGINT) AS batch_size FROM items GROUP BY ALL),
  dist AS (SELECT lower(service) AS service_key, list_name, item, min(ord) AS ord FROM items GROUP BY ALL),
  merged AS (SELECT h.*, coalesce(problems, []) AS problems, coalesce(tips, []) AS tips, coalesce(cost_info, []) AS cost_info, coalesce(settings, []) AS settings FROM heads h JOIN
    (SELECT service_key, list(item ORDER BY item) FILTER (WHERE list_name = 'problems') AS problems, list(item ORDER BY item) FILTER (WHERE list_name = 'tips') AS tips,
      list(item ORDER BY item) FILTER (WHERE list_name = 'cost_info') AS cost_info, list(item ORDER BY ord) FILTER (WHERE list_name = 'settings') AS settings FROM dist GROUP BY service_key) USING (service_key))"""


def _merged(spark, d):
    return merge.merge_by_service(tables.extractions(spark, d))


@query("merge_by_service", f"WITH {_MERGED} SELECT service_key, service, CAST(epoch_us(ts) AS BIGINT) AS ts_us, batch_size, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in merge.LISTS) + " FROM merged")
def merge_by_service(spark, d):
    return _merged(spark, d).select("service_key", "service", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "batch_size", *(F.array_join(c, "|").alias(c) for c in merge.LISTS))


_JSON_LIST = "'\"' || '{0}' || '\": [' || array_to_string(list_transform(list_sort({0}), lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || ']'"


@query("content_hash", f"WITH {_MERGED} SELECT service_key, md5('{{' || " + " || ', ' || ".join(_JSON_LIST.format(c) for c in sorted(merge.LISTS)) + " || '}') AS content_hash FROM merged")
def content_hash(spark, d):
    return merge.content_hash(_merged(spark, d))


@query("top_services", f"WITH {S.ITEMS} SELECT service, CAST(sum(batch_size) AS BIGINT) AS posts, min(ord) AS ord FROM items GROUP BY service ORDER BY posts DESC, ord LIMIT 5")
def top_services(spark, d):
    return tables.extractions(spark, d).groupBy("service").agg(F.sum("batch_size").alias("posts"), F.min("ord").alias("ord")).orderBy(F.desc("posts"), "ord").limit(5)


@query("run_stats", f"WITH {_MERGED} SELECT CAST(sum(len(problems)) AS BIGINT) AS problems, CAST(sum(len(tips)) AS BIGINT) AS tips, CAST(sum(len(cost_info)) AS BIGINT) AS cost_info, CAST(sum(len(settings)) AS BIGINT) AS settings, CAST(sum(batch_size) AS BIGINT) AS posts FROM merged")
def run_stats(spark, d):
    return _merged(spark, d).agg(*(F.sum(F.size(c)).cast("long").alias(c) for c in merge.LISTS), F.sum("batch_size").alias("posts"))


@query("success_split", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT user_id) AS services FROM events")
def success_split(spark, d):
    e = tables.table(spark, d, "events")
    return e.agg(F.count_if(F.col("event_type") != "error").alias("successful"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("user_id").alias("services"))


@query(
    "practice_group",
    """WITH p AS (SELECT event_id AS ord, event_type AS kind, props, value, unnest(['m' || (user_id % 9), 'General', 'LLaMA (x)']) AS m FROM events),
    k AS (SELECT *, CASE WHEN lower(trim(regexp_replace(m, '\\s*\\([^)]*\\)\\s*', '', 'g'))) = 'llama' THEN 'llama-3' ELSE m END AS model FROM p WHERE lower(m) NOT IN ('general', 'unknown', 'ai', 'llm'))
    SELECT model, count(*) FILTER (WHERE kind = 'click') AS n_tips, count(*) FILTER (WHERE kind = 'view') AS n_settings, count(*) FILTER (WHERE kind = 'error') AS n_problems, count(*) FILTER (WHERE kind = 'purchase') AS n_costs,
      md5(string_agg(kind || ' - ' || props, '|' ORDER BY ord) FILTER (WHERE kind = 'click')) AS tips_md5 FROM k GROUP BY model""",
)
def practice_group(spark, d):
    e = tables.table(spark, d, "events")
    k = F.col("event_type")
    p = e.select(
        F.col("event_id").alias("ord"), F.array(F.concat(F.lit("m"), (F.col("user_id") % 9).cast("string")), F.lit("General"), F.lit("LLaMA (x)")).alias("models"),
        F.when(k == "click", "tip").when(k == "error", "problem").alias("type"), k.alias("content"), F.when(k == "view", "config").when(k == "click", F.col("props")).alias("details"),
        F.when(k == "error", F.col("props")).alias("problem"), F.lit(None).cast("string").alias("solution"), F.when(k == "purchase", F.col("props")).alias("savings"),
    )
    n = lambda c, a: F.size(c).cast("long").alias(a)
    return merge.practice_groups(p).select("model", n("tips", "n_tips"), n("settings", "n_settings"), n("problems", "n_problems"), n("cost_info", "n_costs"), F.md5(F.array_join("tips", "|")).alias("tips_md5"))


@query("confidence", "SELECT event_type AS entity, round(avg(coalesce(CASE WHEN event_id % 5 <> 0 THEN value / 20 END, 0.5)), 6) AS confidence FROM events GROUP BY event_type UNION ALL SELECT 'overall', least(1.0, count(*) / 10) FROM events")
def confidence(spark, d):
    p = tables.table(spark, d, "events").select(F.col("event_type").alias("entity"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 20).alias("confidence"))
    return merge.confidence(p).select("entity", F.round("confidence", 6).alias("confidence"))


@query(
    "chunk_merge",
    "SELECT 's' || (user_id % 20) AS name, round(coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 0.5), 6) AS quality, count(*) FILTER (WHERE event_type = 'click') AS n_practices, md5(string_agg(props, '|' ORDER BY event_id) FILTER (WHERE event_type = 'click')) AS practices_md5 FROM events GROUP BY ALL",
)
def chunk_merge(spark, d):
    e = tables.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("ord"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("name"), F.when(F.col("event_type") == "click", F.col("props")).alias("practice"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("quality"))
    return merge.chunk_results(rows).select("name", F.round("quality", 6).alias("quality"), "n_practices", F.md5(F.array_join("practices", "|")).alias("practices_md5"))


@query("extraction_confidence", "SELECT p_partkey, CASE WHEN s = 0 THEN 0.0::DOUBLE WHEN s = 1 AND p < 3 THEN 0.3 WHEN s < 3 AND p < 5 THEN 0.5 WHEN s < 5 AND p < 10 THEN 0.7 ELSE 0.9 END AS confidence FROM (SELECT p_partkey, p_partkey % 7 AS s, p_size % 12 AS p FROM part)")
def extraction_confidence(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", merge.extraction_confidence(F.col("p_partkey") % 7, F.col("p_size") % 12).alias("confidence"))


@query("rule_extraction")
def rule_extraction(spark, d):
    """The offline extractor over packed batches of every post."""
    return extract.extract(pack.asked(tables.posts(spark, d).withColumnRenamed("community", "service"), usable=2000, base=100), extract.RuleExtractor)


@query(
    "resumed_extraction",
    """WITH RECURSIVE p AS (SELECT source AS service, length(split_part(text, chr(10), 1) || substr(text, 1, 500)) // 4 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IS NOT NULL),
    f(service, i, held, batches) AS (SELECT service, 0::BIGINT, 1000000::BIGINT, 0::BIGINT FROM p GROUP BY service
      UNION ALL SELECT f.service, p.i, CASE WHEN held + cost <= 1900 THEN held + cost ELSE cost END, batches + CASE WHEN held + cost <= 1900 THEN 0 ELSE 1 END FROM f JOIN p ON p.service = f.service AND p.i = f.i + 1)
    SELECT service, max(batches) AS n_batches, (SELECT count(*) FROM p x WHERE x.service = f.service) AS n_posts, 0::BIGINT AS asked_again FROM f GROUP BY service""",
)
def resumed_extraction(spark, d):
    """Every post asked about once, in batches; a second run finds all replies kept and asks nothing."""
    path = shared.folder(spark, "replies")
    batches = pack.asked(tables.posts(spark, d).withColumnRenamed("community", "service"), usable=2000, base=100)
    extract.extract_resumable(batches, extract.RuleExtractor, path, rounds=2)
    again = extract.ask_missing(batches.withColumn("prompt", extract.prompt_column("service", "posts")), extract.RuleExtractor, path, rounds=1)
    found = extract.extract_resumable(batches, extract.RuleExtractor, path, rounds=1)
    return found.groupBy("service").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("batch_size").alias("n_posts"), F.lit(again).cast("long").alias("asked_again"))


# --- search

QUESTIONS = ("small ring", "Smal Ring", "red-widget", "blu bolt", "gear", "hot", "zzzzqq", "red", "")
_E = f"{S.SERVICES}, entries AS (SELECT name, min(ord) AS ord, arg_min(category, ord) AS category FROM services GROUP BY name), q AS (SELECT * FROM " + S.values([(x,) for x in QUESTIONS], "query") + ")"
_F = f"""{_E}, f AS (SELECT query, name, category, ord, round({S.similarity('query', 'name')}, 6) AS similarity FROM q CROSS JOIN entries)"""
_TYPE = "CASE WHEN similarity = 1 THEN 'exact' WHEN similarity >= 0.8 THEN 'close' ELSE 'fuzzy' END AS match_type"


def _asked(spark):
    return spark.createDataFrame([(x,) for x in QUESTIONS], "query string")


@query("fuzzy_topk", f"WITH {_F} SELECT * FROM (SELECT query, name, category, ord, similarity, {_TYPE}, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, ord) AS INT) AS rank FROM f WHERE similarity >= 0.3) WHERE rank <= 5")
def fuzzy_topk(spark, d):
    return search.top_matches(_asked(spark), tables.services(spark, d))


@query("suggestions", f"WITH {_F} SELECT query, name, rank, CAST(floor(similarity * 100 + 0.5) AS BIGINT) AS confidence FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, ord) AS INT) AS rank FROM f WHERE similarity >= 0.2) WHERE rank <= 3")
def suggestions(spark, d):
    return search.suggestions(_asked(spark), tables.services(spark, d))


@query(
    "best_match",
    f"""WITH {_F}, own AS (SELECT lower(name) AS key, arg_max(name, ord) AS exact FROM services GROUP BY 1), same AS (SELECT {S.normal('name')} AS key, arg_max(name, ord) AS same FROM services GROUP BY 1),
    v AS (SELECT name, ord, unnest(list_distinct([nullif(regexp_extract(lower(name), '^[a-z]+\\d*'), ''), lower(name), replace(lower(name), '-', '_')])) AS key FROM entries), varied AS (SELECT key, arg_min(name, ord) AS varied FROM v GROUP BY key),
    near AS (SELECT query, arg_max(name, (similarity, -ord)) AS near, max(similarity) AS s FROM f WHERE similarity >= 0.3 GROUP BY query)
    SELECT query, coalesce(exact, varied, same, near) AS name, CASE WHEN coalesce(exact, varied) IS NOT NULL THEN 1.0::DOUBLE WHEN same IS NOT NULL THEN 0.95 ELSE s END AS similarity,
      CASE WHEN coalesce(exact, varied) IS NOT NULL THEN 'exact' WHEN same IS NOT NULL THEN 'normalized' WHEN s = 1 THEN 'exact' WHEN s >= 0.8 THEN 'close' ELSE 'fuzzy' END AS match_type
    FROM q LEFT JOIN own ON own.key = lower(query) LEFT JOIN varied ON varied.key = lower(query) LEFT JOIN same ON same.key = {S.normal('query')} LEFT JOIN near USING (query) WHERE coalesce(exact, varied, same, near) IS NOT NULL""",
)
def best_match(spark, d):
    return search.best_match(_asked(spark), tables.services(spark, d))


@query(
    "fuzzy_join",
    f"""{"WITH " + S.SERVICES}, entries AS (SELECT name, min(ord) AS ord, arg_min(category, ord) AS category FROM services GROUP BY name), q AS (SELECT DISTINCT replace(p_name, 'i', 'y') || CASE p_size % 3 WHEN 0 THEN 's' ELSE '' END AS query FROM part),
    f AS (SELECT query, name, category, ord, round({S.similarity('query', 'name')}, 6) AS similarity FROM q CROSS JOIN entries) SELECT *, {_TYPE} FROM f WHERE similarity >= 0.6""",
)
def fuzzy_join(spark, d):
    """Misspelt names of a table with the entries of a table, at 0.6, through the index of grams."""
    q = tables.table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit("i"), F.lit("y")), F.when(F.col("p_size") % 3 == 0, "s").otherwise("")).alias("query")).distinct()
    return search.fuzzy_matches(q, tables.services(spark, d), threshold=0.6)


@query(
    "context_join",
    f"""WITH k AS (SELECT p_partkey AS ord, lower(p_brand) || '/' || replace(p_name, ' ', '-') || '-' || p_size AS model_id, CAST(1000 + p_size AS BIGINT) AS context_length FROM part),
    m AS (SELECT DISTINCT replace(p_name, ' ', '-') AS model FROM part UNION SELECT DISTINCT replace(p_name, ' ', '-') || '-' || p_size FROM part UNION SELECT lower(p_type) FROM part)
    SELECT model, CAST(coalesce((SELECT arg_max(context_length, ord) FROM k WHERE model_id = model), (SELECT arg_min(context_length, ord) FROM k WHERE contains(model_id, model)), {S.first_rule('lower(model)', [(n, w) for w, n in L.CONTEXT_DEFAULTS], '8192')}) AS BIGINT) AS context_length FROM m""",
)
def context_join(spark, d):
    """Lengths of models whose names stand within the ids of a table."""
    p = tables.table(spark, d, "part")
    named = F.replace("p_name", F.lit(" "), F.lit("-"))
    known = p.select(F.col("p_partkey").alias("ord"), F.concat(F.lower("p_brand"), F.lit("/"), named, F.lit("-"), F.col("p_size").cast("string")).alias("model_id"), (F.col("p_size") + 1000).alias("context_length"))
    models = p.select(named.alias("model")).union(p.select(F.concat(named, F.lit("-"), F.col("p_size").cast("string")))).union(p.select(F.lower("p_type"))).distinct()
    return search.context_lengths(models, known).select("model", "context_length")


@query("substring_search", f"WITH {_E} SELECT name, ord, category FROM entries WHERE contains(lower(name), 'ri') ORDER BY category, name LIMIT 10")
def substring_search(spark, d):
    return search.substring(tables.services(spark, d), "RI")


@query("site_search", f"WITH {_E} SELECT name, category, CAST(row_number() OVER (ORDER BY lower(name), ord) AS BIGINT) AS place FROM entries WHERE contains(lower(concat_ws(' ', category, name, 'Guide to ' || name, 'tag1 tag2', '')), 'guide to r')")
def site_search(spark, d):
    from pyspark.sql import Window

    e = search.entry_index(tables.services(spark, d)).select("name", "ord", "category", F.lit(None).cast("string").alias("title"), F.array(F.lit("tag1"), F.lit("tag2")).alias("tags"), F.concat(F.lit("Guide to "), "name").alias("summary"))
    found = search.site_search(e, "guide to r")
    return found.select("name", "category", F.row_number().over(Window.orderBy(F.lower("name"), "ord")).cast("long").alias("place"))


_USE = [(u, c) for u, cs in L.USE_CASES.items() for c in cs]
_AS_KIND = "CASE category WHEN 'promo' THEN 'code' WHEN 'small' THEN 'image' WHEN 'large' THEN 'text' WHEN 'medium' THEN 'multimodal' ELSE category END"


@query("recommend", f"WITH {S.SERVICES}, e AS (SELECT name, arg_min({_AS_KIND}, ord) AS category FROM services GROUP BY name) SELECT use_case, category, name FROM e JOIN " + S.values(_USE, "use_case, category") + " USING (category)")
def recommend(spark, d):
    c = F.col("category")
    kind = F.when(c == "promo", "code").when(c == "small", "image").when(c == "large", "text").when(c == "medium", "multimodal").otherwise(c)
    return search.recommend(spark, tables.services(spark, d).withColumn("category", kind))


_KNOWN = [(0, "openai/gpt-4", 8192), (1, "acme/small ring", 1000), (2, "acme/red widget v2", 2000), (3, "blue bolt", 3000), (4, "big/blue bolt", 4000)]


@query(
    "context_lookup",
    f"WITH k AS (SELECT * FROM {S.values(_KNOWN, 'ord, model_id, context_length')}), m AS (SELECT DISTINCT p_name AS model FROM part UNION SELECT * FROM (VALUES ('gpt-4-turbo-x'), ('claude-3-z'), ('mistral-7b'))) SELECT model, CAST(coalesce((SELECT arg_max(context_length, ord) FROM k WHERE model_id = model), (SELECT arg_min(context_length, ord) FROM k WHERE contains(model_id, model) OR ends_with(model_id, '/' || model)), {S.first_rule('lower(model)', [(n, w) for w, n in L.CONTEXT_DEFAULTS], '8192')}) AS BIGINT) AS context_length FROM m",
)
def context_lookup(spark, d):
    m = tables.table(spark, d, "part").select(F.col("p_name").alias("model")).union(spark.createDataFrame([("gpt-4-turbo-x",), ("claude-3-z",), ("mistral-7b",)], "model string")).distinct()
    return search.context_lengths(m, spark.createDataFrame(_KNOWN, "ord int, model_id string, context_length int")).select("model", "context_length")


@query("entry_counts_rollup", "SELECT lower(p_type) AS category, count(*) AS n FROM part GROUP BY ROLLUP (lower(p_type))")
def entry_counts_rollup(spark, d):
    return tables.services(spark, d).rollup("category").agg(F.count(F.lit(1)).alias("n"))


# --- updates

_LOG = "SELECT 'svc' || user_id AS service_key, ts, CAST(round(value) AS BIGINT) AS total FROM events"


def _log(spark, d):
    e = tables.table(spark, d, "events")
    return e.select(F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("service_key"), "ts", F.round("value").cast("long").alias("total"))


def _days(a: str, b: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {a}, {b}) / 86400000000) AS BIGINT)"


_STATUS = f"SELECT service_key, {_days('max(ts)', f'TIMESTAMP {chr(39)}{AS_OF}{chr(39)}')} AS days FROM ({_LOG}) GROUP BY service_key"


@query("update_status", f"SELECT service_key, days, CASE WHEN days < 7 THEN 'recent' WHEN days > 30 THEN 'stale' ELSE 'current' END AS status FROM ({_STATUS})")
def update_status(spark, d):
    return incremental.update_status(_log(spark, d), AS_OF)


@query("stale_services", f"SELECT service_key FROM ({_STATUS}) WHERE days >= 5")
def stale_services(spark, d):
    return incremental.update_status(_log(spark, d), AS_OF).where("days >= 5").select("service_key")


@query(
    "should_update",
    f"""WITH n AS (SELECT 'svc' || user_id AS service_key, count(*) AS total FROM events GROUP BY ALL UNION ALL SELECT 'new', 3), l AS ({_LOG}), o AS (SELECT service_key, max(ts) AS ts, arg_max(total, (ts, total)) AS old FROM l GROUP BY service_key)
    SELECT service_key, total, (ts IS NULL OR {_days('ts', f"TIMESTAMP '{AS_OF}'")} > 7 OR total > 1.3::DOUBLE * old) AS should_update FROM n LEFT JOIN o USING (service_key)""",
)
def should_update(spark, d):
    e = tables.table(spark, d, "events")
    new = e.groupBy(F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("service_key")).agg(F.count(F.lit(1)).alias("total"))
    new = new.unionByName(spark.createDataFrame([("new", 3)], "service_key string, total long")).withColumn("ts", F.lit(None).cast("timestamp"))
    return incremental.should_update(new, _log(spark, d), AS_OF)


@query("should_scrape", "WITH s AS (SELECT DISTINCT source FROM documents), l AS (SELECT 'src' || (user_id % 25) AS source, max(ts) AS last FROM events GROUP BY ALL) SELECT source, coalesce(date_diff('microsecond', last, TIMESTAMP '2024-01-31 12:00:00') > 24 * 3600000000, TRUE) AS should_scrape FROM s LEFT JOIN l USING (source)")
def should_scrape(spark, d):
    state = tables.table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("source"), "ts")
    return incremental.should_scrape(tables.table(spark, d, "documents"), state, "2024-01-31 12:00:00")


@query("cadence", f"SELECT service_key, count(*) AS n_updates, round({_days('min(ts)', 'max(ts)')} / count(*), 6) AS days_per_update FROM ({_LOG}) GROUP BY service_key")
def cadence(spark, d):
    return incremental.cadence(_log(spark, d))


@query("update_upsert", f"WITH l AS ({_LOG}), o AS (SELECT service_key, arg_max(total, (ts, total)) AS total FROM l WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), n AS (SELECT service_key, arg_max(total, (ts, total)) AS total FROM l WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL) SELECT * FROM n UNION ALL SELECT * FROM o WHERE service_key NOT IN (SELECT service_key FROM n)")
def update_upsert(spark, d):
    log = _log(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old, new = (incremental.latest(log.where(c)).select("service_key", "total") for c in (F.col("ts") < cut, F.col("ts") >= cut))
    return incremental.upsert(old, new, "service_key")


@query(
    "changed_entries",
    """WITH a AS (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_size > 5), b AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN p_type || ' v2' ELSE p_type END AS v FROM part WHERE p_size <> 20)
    SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""",
)
def changed_entries(spark, d):
    """Two snapshots of all parts: the smallest come later, those of one size go, the largest change."""
    p, v = tables.table(spark, d, "part").withColumnRenamed("p_partkey", "name"), F.col("p_type")
    before = p.where("p_size > 5").select("name", v.alias("v"))
    after = p.where("p_size <> 20").select("name", F.when(F.col("p_size") > 40, F.concat(v, F.lit(" v2"))).otherwise(v).alias("v"))
    return incremental.changed(before, after, "name", "v")


# --- validation

_RULES = f"""WITH s AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not a url' ELSE 'https://x.org/' || (p_partkey % 700) END AS url,
    CASE WHEN p_size < 10 THEN 'urgent' WHEN p_size < 20 THEN NULL ELSE 'high' END AS priority, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS n_models FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM s)
  SELECT name AS entity, 'error' AS severity, 'missing_name' AS rule, 'name is required' AS message FROM r WHERE trim(name) = ''
  UNION ALL SELECT name, 'error', 'missing_url', 'url is required' FROM r WHERE coalesce(trim(url), '') = ''
  UNION ALL SELECT name, 'error', 'bad_url', 'not a URL: ' || url FROM r WHERE url IS NOT NULL AND NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+')
  UNION ALL SELECT name, 'error', 'duplicate_url', 'duplicate URL: ' || url FROM r WHERE rn > 1 AND url IS NOT NULL
  UNION ALL SELECT name, 'error', 'bad_priority', 'priority: ' || coalesce(priority, 'none') FROM r WHERE coalesce(priority, '') NOT IN ('ultra', 'critical', 'high', 'medium', 'low')
  UNION ALL SELECT name, 'warning', 'no_models', 'no models' FROM r WHERE n_models = 0"""


def _findings(spark, d):
    k = F.col("p_partkey")
    s = tables.table(spark, d, "part").select(
        k.alias("ord"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 5 == 1, "not a url").when(k % 5 != 0, F.concat(F.lit("https://x.org/"), (k % 700).cast("string"))).alias("url"),
        F.when(F.col("p_size") < 10, "urgent").when(F.col("p_size") >= 20, "high").alias("priority"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m"))).alias("models"),
    )
    return validate.source_findings(s)


@query("validation_findings", _RULES)
def validation_findings(spark, d):
    return _findings(spark, d)


@query("validation_counts", f"SELECT severity, rule, count(*) AS n FROM ({_RULES}) GROUP BY ROLLUP (severity, rule)")
def validation_counts(spark, d):
    return _findings(spark, d).rollup("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("missing_fields", "SELECT p_partkey, array_to_string(list_sort(list_filter(['api', 'promo', 'ring', 'small'], lambda x: NOT list_contains(string_split(lower(p_name || ' ' || p_type), ' '), x))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: list_contains(['api', 'promo', 'ring', 'small'], x)))), ',') AS present FROM part")
def missing_fields(spark, d):
    want, has = F.array(*map(F.lit, ("api", "promo", "ring", "small"))), F.split(F.lower(F.concat("p_name", F.lit(" "), "p_type")), " ")
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return tables.table(spark, d, "part").select("p_partkey", join(F.array_except(want, has)).alias("missing"), join(F.array_intersect(has, want)).alias("present"))


# --- documents

_SEC = lambda title, col: f"CASE WHEN len({col}) > 0 THEN '## {title}' || chr(10) || chr(10) || array_to_string(list_transform({col}, lambda t: '- ' || t || chr(10)), '') || chr(10) ELSE '' END"
_DATE = f"'*Last updated: {DAY}*' || chr(10) || chr(10)"
_MONEY = f"list_filter(tips, lambda t: {S.any_of('lower(t)', L.MONEY_WORDS)})"


_PROMPTING = f"""'# ' || service || ' Prompting Guide' || chr(10) || chr(10) || {_DATE} || {_SEC('Tips & Techniques', 'tips')} || {_SEC('Recommended Settings', 'settings')} ||
    CASE WHEN len(tips) + len(settings) = 0 THEN '*No specific prompting tips available yet. Check back for updates.*' || chr(10) || chr(10) ELSE '' END || '## Sources' || chr(10) || chr(10) || '- Reddit community discussions' || chr(10) || '- User-reported experiences' || chr(10)"""
_COST = f"""'# ' || service || ' - Cost Optimization Guide' || chr(10) || chr(10) || {_DATE} || {_SEC('Cost & Pricing Information', 'cost_info')} || {_SEC('Money-Saving Tips', _MONEY)} ||
    CASE WHEN len(cost_info) + len({_MONEY}) = 0 THEN '*No cost optimization information available yet.*' || chr(10) || chr(10) ELSE '' END"""


@query(
    "render_prompting",
    f"WITH {_MERGED} SELECT service_key, {_PROMPTING} AS content FROM merged",
)
def render_prompting(spark, d):
    return _merged(spark, d).select("service_key", render.prompting(F.col("service"), F.col("tips"), F.col("settings"), DAY).alias("content"))


@query(
    "render_cost",
    f"WITH {_MERGED} SELECT service_key, {_COST} AS content FROM merged",
)
def render_cost(spark, d):
    return _merged(spark, d).select("service_key", render.cost_optimization(F.col("service"), F.col("cost_info"), F.col("tips"), DAY).alias("content"))


_P = """p AS (SELECT p_brand AS service, list(p_name || CASE p_partkey % 6 WHEN 0 THEN ' API key error' WHEN 1 THEN ' stutter' WHEN 2 THEN ' trial account' WHEN 3 THEN ' ban policy' WHEN 4 THEN ' credit use' ELSE ' nothing' END ORDER BY p_partkey) AS problems,
  list(p_type || CASE p_partkey % 4 WHEN 0 THEN ' limit' WHEN 1 THEN ' costs $5' WHEN 2 THEN ' Unlimited' ELSE ' other' END ORDER BY p_partkey) AS costs, list(p_name || CASE p_partkey % 3 WHEN 0 THEN ' slower' WHEN 1 THEN ' break tag' ELSE '' END ORDER BY p_partkey) AS settings FROM part GROUP BY p_brand)"""


def _parts(spark, d):
    k = F.col("p_partkey")
    pick = lambda opts, n, base: F.concat(base, F.element_at(F.array(*map(F.lit, opts)), (k % n + 1).cast("int")))
    row = F.struct(
        k, pick((" API key error", " stutter", " trial account", " ban policy", " credit use", " nothing"), 6, F.col("p_name")).alias("p"),
        pick((" limit", " costs $5", " Unlimited", " other"), 4, F.col("p_type")).alias("c"), pick((" slower", " break tag", ""), 3, F.col("p_name")).alias("s"),
    )
    g = tables.table(spark, d, "part").groupBy(F.col("p_brand").alias("service")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select("service", F.transform("r", lambda x: x["p"]).alias("problems"), F.transform("r", lambda x: x["c"]).alias("costs"), F.transform("r", lambda x: x["s"]).alias("settings"))


_FIX = """CASE WHEN contains(lower(x), 'stutter') THEN '**Fix**: Keep speech rate adjustments under 5%. Record slower initially rather than slowing down in post.' || chr(10) || chr(10) WHEN contains(lower(x), 'api key') THEN '**Fix**: Store API keys in environment variables or use a secrets manager.' || chr(10) || chr(10) ELSE chr(10) END"""
_NOTE = "CASE WHEN contains(lower(x), 'trial') OR contains(lower(x), 'account') THEN '**Note**: Be aware of terms of service regarding account creation.' || chr(10) || chr(10) ELSE chr(10) END"
_KINDOF = S.first_rule("lower(x)", [(S.quoted(k), w) for k, w in L.PROBLEM_KINDS], "''")
_PIT = lambda title, items, mark, tail: f"CASE WHEN len({items}) > 0 THEN '## {title}' || chr(10) || chr(10) || array_to_string(list_transform({items}, lambda x: '### {mark} ' || x || chr(10) || {tail}), '') ELSE '' END"


_KINDS = f"""list_filter(problems, lambda x: {_KINDOF} = 'technical') AS t, list_filter(problems, lambda x: {_KINDOF} = 'policy') AS o,
      list_concat(list_filter(problems, lambda x: {_KINDOF} = 'cost'), list_filter(costs, lambda x: contains(lower(x), 'limit') OR contains(lower(x), 'character'))) AS c"""
_PITFALLS = f"""'# ' || service || ' - Common Pitfalls & Issues' || chr(10) || chr(10) || {_DATE} || {_PIT('Technical Issues', 't', '⚠️', _FIX)} || {_PIT('Policy & Account Issues', 'o', '⚠️', _NOTE)} || {_PIT('Cost & Limits', 'c', '💰', 'chr(10)')} ||
      CASE WHEN len(t) + len(o) + len(c) = 0 THEN '*No major issues reported yet. This may indicate limited community data.*' || chr(10) || chr(10) ELSE '' END"""


@query(
    "render_pitfalls",
    f"WITH {_P}, k AS (SELECT service, {_KINDS} FROM p) SELECT service, {_PITFALLS} AS content FROM k",
)
def render_pitfalls(spark, d):
    return _parts(spark, d).select("service", render.pitfalls(F.col("service"), F.col("problems"), F.col("costs"), DAY).alias("content"))


_PARAMETERS = (
    """x AS (SELECT service, 'setting_' AS part, unnest(settings) AS d, generate_subscripts(settings, 1) AS i FROM p UNION ALL SELECT service, 'tip_', unnest(costs), generate_subscripts(costs, 1) FROM p),
    n AS (SELECT *, CASE part WHEN 'setting_' THEN CASE WHEN contains(lower(d), 'break') AND contains(lower(d), 'tag') THEN 'speech_pauses' WHEN contains(lower(d), 'speech rate') OR contains(lower(d), 'slower') THEN 'speech_rate' END
      ELSE CASE WHEN contains(d, '$') THEN 'pricing' WHEN contains(lower(d), 'unlimited') THEN 'unlimited_option' END END AS kind FROM x),
    f AS (SELECT *, kind IS NULL OR row_number() OVER (PARTITION BY service, part, kind ORDER BY i) = 1 AS opens FROM n),
    g AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY service, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM f),
    e AS (SELECT service, part, coalesce(kind, part || k) AS key, min(i) AS place, arg_max(d, i) AS d FROM g GROUP BY 1, 2, 3),
    j AS (SELECT service, part, place, '"' || key || '":' AS head, CAST(to_json(d) AS VARCHAR) AS d, CASE key WHEN 'speech_pauses' THEN ',"value":"<break time=\\"1.5s\\" />"' WHEN 'speech_rate' THEN ',"value":"slower_preferred"' ELSE '' END AS v FROM e),
    o AS (SELECT service, coalesce(string_agg(head || '{"description":' || d || v || '}', ',' ORDER BY place) FILTER (WHERE part = 'setting_'), '') AS r, coalesce(string_agg(head || d, ',' ORDER BY place) FILTER (WHERE part = 'tip_'), '') AS c FROM j GROUP BY service)
    SELECT service, '{"service":' || CAST(to_json(service) AS VARCHAR) || ',"last_updated":"""
    + f'"{DAY}"'
    + ""","recommended_settings":{' || r || '},"cost_optimization":{' || c || '},"sources":["Reddit community","User reports"]}' AS content FROM o"""
)


@query("render_parameters", f"WITH {_P}, {_PARAMETERS}")
def render_parameters(spark, d):
    return _parts(spark, d).select("service", render.parameters(F.col("service"), F.col("settings"), F.col("costs"), DAY).alias("content"))


def _tree(spark, d):
    m = _merged(spark, d)
    return render.files(m.withColumn("category", names.fallback_category(F.col("service"), F.lit(None).cast("string"))), DAY)


#: The tree's files; md5 of the markdown ones' contents (the JSON ones' fields are compared in render_parameters and render_metadata).
_FILES_SQL = f"""WITH {_MERGED}, k AS (SELECT service_key, service, {_KINDS.replace('costs', 'cost_info')} FROM merged), told AS (SELECT service_key, {_PITFALLS} AS pitfalls FROM k),
    docs AS (SELECT *, {_PROMPTING} AS prompting, {_COST} AS cost FROM merged JOIN told USING (service_key))
    SELECT lower(service) AS slug, f AS file, CASE f WHEN 'prompting.md' THEN md5(prompting) WHEN 'pitfalls.md' THEN md5(pitfalls) WHEN 'cost_optimization.md' THEN md5(cost) END AS md5
    FROM docs, (VALUES ('prompting.md'), ('parameters.json'), ('pitfalls.md'), ('cost_optimization.md'), ('metadata.json')) AS t(f)
    WHERE CASE f WHEN 'prompting.md' THEN len(tips) + len(settings) > 0 WHEN 'parameters.json' THEN len(settings) + len(cost_info) > 0 WHEN 'pitfalls.md' THEN len(problems) > 0 OR len(list_filter(cost_info, lambda x: contains(lower(x), 'limit'))) > 0
      WHEN 'cost_optimization.md' THEN len(cost_info) > 0 OR len(list_filter(tips, lambda x: contains(lower(x), 'free') OR contains(lower(x), 'unlimited'))) > 0 ELSE TRUE END"""


def _md5():
    return F.when(F.col("file").endswith(".md"), F.md5(F.col("content").cast("binary"))).alias("md5")


@query("entry_files", _FILES_SQL)
def entry_files(spark, d):
    return _tree(spark, d).select("slug", "file", _md5())


@query("render_metadata", f"WITH {_MERGED} SELECT lower(service) AS slug, service, 'general' AS category, batch_size AS posts_analyzed, 'medium' AS confidence FROM merged")
def render_metadata(spark, d):
    j = lambda k: F.get_json_object("content", f"$.{k}")
    return _tree(spark, d).where("file = 'metadata.json'").select("slug", j("service").alias("service"), j("category").alias("category"), j("posts_analyzed").cast("long").alias("posts_analyzed"), j("confidence").alias("confidence"))


@query("manifest", f"WITH {_MERGED} SELECT 'general' AS category, lower(service) AS model, lower(service) AS title, CAST(1 + CAST(len(tips) + len(settings) > 0 AS INT) + CAST(len(settings) + len(cost_info) > 0 AS INT) + CAST(len(problems) > 0 AS INT) + CAST(len(cost_info) > 0 AS INT) AS BIGINT) AS n_paths FROM merged")
def manifest(spark, d):
    return render.manifest(_tree(spark, d)).select("category", "model", "title", F.size("paths").cast("long").alias("n_paths"))


@query("export_json", f"SELECT 'general' AS category, slug, file, md5 FROM ({_FILES_SQL})")
def export_json(spark, d):
    """The export, read as JSON again: what it holds by category, slug and file."""
    e = render.export_json(_tree(spark, d)).select("category", F.explode(F.from_json("content", "map<string,map<string,string>>")).alias("slug", "files"))
    return e.select("category", "slug", F.explode("files").alias("file", "content")).where("content != ''").select("category", "slug", "file", _md5())


@query("corpus_findings", f"WITH {_MERGED} SELECT 'general/' || lower(service) AS entity, 'error' AS severity, 'missing_file' AS rule, 'prompting.md' AS message FROM merged WHERE len(tips) + len(settings) = 0 UNION ALL SELECT 'general/' || lower(service), 'warning', 'outdated', 'metadata.json' FROM merged")
def corpus_findings(spark, d):
    return validate.corpus_findings(_tree(spark, d), "2025-01-01 00:00:00")


@query("entry_tree_sink", f"SELECT 'general' AS category, slug, file, md5 FROM ({_FILES_SQL})")
def entry_tree_sink(spark, d):
    """The tree, written by the executors under its files' own names and read again."""
    tree, root = _tree(spark, d), shared.folder(spark, "entries")
    return render.publish(tree, root).select("category", "slug", "file", _md5())


@query(
    "observed_run",
    """WITH RECURSIVE p AS (SELECT source AS service, length(split_part(text, chr(10), 1) || substr(text, 1, 500)) // 4 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IS NOT NULL),
    f(service, i, held, batches) AS (SELECT service, 0::BIGINT, 1000000::BIGINT, 0::BIGINT FROM p GROUP BY service
      UNION ALL SELECT f.service, p.i, CASE WHEN held + cost <= 1900 THEN held + cost ELSE cost END, batches + CASE WHEN held + cost <= 1900 THEN 0 ELSE 1 END FROM f JOIN p ON p.service = f.service AND p.i = f.i + 1)
    SELECT (SELECT sum(n)::BIGINT FROM (SELECT max(batches) AS n FROM f GROUP BY service)) AS batches, (SELECT count(*) FROM p) AS posts, 0::BIGINT AS failed, count(*) AS asked FROM p""",
)
def observed_run(spark, d):
    """Counters of a run, observed as its results and its posts are written, in the passes that write them."""
    posts, root = tables.posts(spark, d).withColumnRenamed("community", "service").where("service is not null"), shared.folder(spark, "observed")
    seen, done = counters.Counters("posts"), counters.Counters("results")
    seen.on(posts, counters.status_metrics("post_id", "post_id")).write.parquet(f"{root}/posts")
    batches = pack.asked(spark.read.parquet(f"{root}/posts"), usable=2000, base=100)
    done.on(extract.extract(batches, extract.RuleExtractor), counters.run_metrics()).write.parquet(f"{root}/results")
    run = done.get()
    return spark.createDataFrame([(run["batches"], run["posts"], run["failed"], seen.get()["rows"])], "batches long, posts long, failed long, asked long")


# --- streams


def _folder(spark) -> str:
    """A folder of the shared one for a stream's state and table."""
    return shared.folder(spark, "stream")


def _events_stream(spark, d):
    schema = tables.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type, props FROM events GROUP BY ALL) GROUP BY ALL")
def stream_dedup(spark, d):
    """Distinct (user, type, props) of the event stream, then counted; the watermark spans the month."""
    out = _folder(spark)
    s = _events_stream(spark, d).withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"))
    polls.run_available(polls.dedup_stream(s, "key", "ts", "60 days").select("user_id", "event_type", "props"), f"{out}/table", f"{out}/state")
    return spark.read.parquet(f"{out}/table").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("source_cap", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth, (SELECT count(DISTINCT source) FROM documents) AS n FROM documents) WHERE nth <= 300 // n")
def source_cap(spark, d):
    """The longest texts of each source, 300 in all divided among the sources."""
    return polls.capped(tables.table(spark, d, "documents").select("source", "doc_id", "n_chars"), 300, F.desc("n_chars"), "doc_id").select("source", "doc_id")


@query("stream_poll", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_poll(spark, d):
    """Two polling runs over the same source: the second finds nothing new."""
    out = _folder(spark)
    for _ in range(2):
        polls.run_available(_events_stream(spark, d).select("event_type", "value"), f"{out}/table", f"{out}/state")
    return spark.read.parquet(f"{out}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("stream_upsert", f"SELECT service_key, arg_max(total, (ts, total)) AS total FROM ({_LOG}) GROUP BY service_key")
def stream_upsert(spark, d):
    out = _folder(spark)
    s = _events_stream(spark, d).select(F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("service_key"), "ts", F.round("value").cast("long").alias("total"))
    polls.upsert_log(spark, s, f"{out}/log", f"{out}/state")
    return polls.read_log(spark, f"{out}/log").select("service_key", "total")


@query(
    "stream_last_scraped",
    """WITH RECURSIVE e AS (SELECT 'src' || user_id AS source, ts FROM events), due(source, ts, n) AS (
      SELECT source, min(ts), 0 FROM e GROUP BY source
      UNION ALL
      SELECT d.source, min(e.ts), d.n + 1 FROM due d JOIN e ON e.source = d.source AND e.ts - d.ts > INTERVAL 24 HOURS GROUP BY d.source, d.n)
    SELECT source, count(*) AS n_due, count(*) FILTER (WHERE n = 0) AS n_first, min(ts) AS earliest, max(ts) AS latest FROM due GROUP BY source""",
)
def stream_last_scraped(spark, d):
    """Every event asks for its user's source; a source is scraped at most once a day. Without expiry no source is new twice."""
    out = _folder(spark)
    asked = _events_stream(spark, d).select(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("source"), "ts")
    state.run_due(spark, asked, f"{out}/table", f"{out}/state", delay="60 days")
    due = spark.read.schema(state.DUE).parquet(f"{out}/table").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return due.groupBy("source").agg(F.count(F.lit(1)).alias("n_due"), F.count_if("first").alias("n_first"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
