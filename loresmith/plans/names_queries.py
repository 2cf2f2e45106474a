"""Queries on names, categories, aliases, the registry and its search plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from loresmith.functions import lookups as L
from loresmith.functions import names
from loresmith.operators import registry, resolve
from loresmith.plans import sql as S
from loresmith.plans.catalogue import query
from loresmith.sources import tables

#: Aliases of the flagship query, frequent in the documents' languages.
ALIASES = [("english", "the "), ("german", "der "), ("french", "que "), ("spanish", "los "), ("secrets", "token")]


@query(
    "mention_topk",
    "WITH m AS (SELECT doc_id, n_chars, canonical FROM documents JOIN " + S.values(ALIASES, "canonical, alias") + " ON contains(lower(text), alias) GROUP BY ALL) "
    "SELECT canonical, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM m GROUP BY canonical ORDER BY n_docs DESC, canonical LIMIT 5",
)
def mention_topk(spark, d):
    m = resolve.mentions(tables.table(spark, d, "documents").select("doc_id", "text", "n_chars"), "text", ALIASES)
    return m.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("total_chars")).orderBy(F.desc("n_docs"), "canonical").limit(5)


def _names_of(spark, d):
    u = [tables.table(spark, d, t).select(F.col(c).alias("name")) for t, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))]
    odd = spark.createDataFrame([(x,) for x in ODD], "name string")
    return u[0].unionByName(u[1]).unionByName(u[2]).unionByName(odd).distinct()


ODD = ("GPT-4 (turbo)", "llama", "Foo Release 2", 'a<b>:"c"', "Stable  Diffusion 3.5", "OpenAI", "Scale AI", "play.ht", "Ünïcode Tool", "x (y) z", "  ", "hub.io", "qwen3-coder", "SD")
_NAMES_SQL = "names AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT * FROM " + S.values([(x,) for x in ODD], "name") + "))"


def _scalar(name, column, oracle, fn):
    @query(name, f"WITH {_NAMES_SQL} SELECT name, {oracle} AS {column} FROM names")
    def run(spark, d):
        return _names_of(spark, d).select("name", fn(F.col("name")).alias(column))


_scalar("name_normalise", "normal", S.normal("name"), names.normalise)
_scalar("name_slug", "slug", r"regexp_replace(replace(lower(name), ' ', '-'), '[^\p{L}\p{N}-]', '', 'g')", names.slug)
_scalar("name_clean", "cleaned", r"trim(regexp_replace(regexp_replace(name, '[^\p{L}\p{N}_\s\-.]', '', 'g'), '\s+', ' ', 'g'))", names.clean)
_scalar("name_canonical", "canonical", S.canonical("name"), names.canonical)
_scalar(
    "name_sanitise", "model",
    r"""CASE WHEN contains(lower(trim(regexp_replace(name, '\s*\([^)]*\)\s*', '', 'g'))), 'release') THEN NULL
      ELSE nullif(CASE WHEN lower(trim(regexp_replace(trim(regexp_replace(name, '\s*\([^)]*\)\s*', '', 'g')), '[<>:"/\\|?*]', '', 'g'))) = 'llama' THEN 'llama-3'
      ELSE trim(regexp_replace(trim(regexp_replace(name, '\s*\([^)]*\)\s*', '', 'g')), '[<>:"/\\|?*]', '', 'g')) END, '') END""",
    names.sanitise_model,
)
_scalar("model_alias", "model", "coalesce((SELECT v FROM " + S.values(list(L.MODEL_ALIASES.items()), "k, v") + " WHERE k = trim(lower(name))), trim(name))", names.model_alias)
_scalar("categorise_pattern", "category", "CASE WHEN name = '' THEN 'text' ELSE " + S.first_rule("lower(name)", [(S.quoted(c), w) for c, w in L.PATTERN_CATEGORIES], "'text'") + " END", names.pattern_category)
_scalar("context_default", "context_length", "CAST(" + S.first_rule("lower(name)", [(n, w) for w, n in L.CONTEXT_DEFAULTS], "8192") + " AS BIGINT)", lambda c: names.context_length(c).cast("long"))
_scalar(
    "entry_variations", "variations",
    r"""array_to_string(list_sort(list_distinct(list_filter([regexp_replace(lower(name), '-[\d.]+[a-z]*$', ''), nullif(regexp_extract(lower(name), '^[a-z]+\d*'), ''), replace(lower(name), '-', '_'),
      replace(lower(name), '_', '-'), regexp_replace(lower(name), '[-_]', ' ', 'g'), regexp_replace(lower(name), '-instruct$', ''), regexp_replace(lower(name), '-chat$', ''),
      regexp_replace(lower(name), '-gguf$', ''), regexp_replace(lower(name), '-1m$', ''), regexp_replace(lower(name), '-cli$', ''), regexp_replace(lower(name), '^gemini-', 'gemini')], lambda x: x IS NOT NULL))), '|')""",
    lambda c: F.array_join(names.variations(c), "|"),
)
_scalar("escape_html", "escaped", """replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')""", names.escape_html)


def _rule(label, in_name, in_both):
    hit = f"({S.any_of('lower(name)', in_name)} OR {S.any_of('hay', in_both)})"
    return f"WHEN {hit}" + (f" AND NOT {S.any_of('hay', L.NOT_TEXT)}" if label == "text" else "") + f" THEN '{label}'"


_CATEGORY = "CASE " + " ".join(_rule(*r) for r in L.CATEGORY_RULES) + " ELSE 'general' END"


@query("categorise", f"WITH {S.SERVICES}, s AS (SELECT *, lower(name || ' ' || description) AS hay FROM services) SELECT ord, {_CATEGORY} AS category FROM s")
def categorise(spark, d):
    s = tables.services(spark, d)
    return s.select("ord", names.category(F.col("name"), F.col("description")).alias("category"))


@query("categorise_fallback", f"WITH {_NAMES_SQL} SELECT name, " + S.first_rule("lower(name)", [(S.quoted(c), w) for c, w in L.FALLBACK_CATEGORIES], "'general'") + " AS category FROM names")
def categorise_fallback(spark, d):
    return _names_of(spark, d).select("name", names.fallback_category(F.col("name"), F.lit(None).cast("string")).alias("category"))


_IS_SERVICE = f"""CASE WHEN len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: x <> '')) > 5 THEN FALSE WHEN {S.any_of('lower(name)', L.SKIP_WORDS)} THEN FALSE
  WHEN {S.any_of('lower(description)', L.ARTICLE_PHRASES)} THEN FALSE WHEN {S.any_of('lower(url)', L.ARTICLE_URLS)} THEN FALSE WHEN {S.any_of('lower(url)', L.SERVICE_URLS)} THEN TRUE
  ELSE {S.any_of("lower(name || ' ' || description)", L.STRONG_WORDS)} AND len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: x <> '')) <= 2 END"""


@query("likely_service", f"WITH {S.SERVICES} SELECT ord, {_IS_SERVICE} AS is_service FROM services")
def likely_service(spark, d):
    return tables.services(spark, d).select("ord", names.is_service(F.col("name"), F.col("url"), F.col("description")).alias("is_service"))


_LIST_SQL = "SELECT p_brand AS source, string_agg('- [' || p_name || '](https://x.ai/' || p_partkey || ') - ' || p_type || ' api' || chr(10) || '**' || p_name || '** : ' || p_type, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand"


@query(
    "list_entries_parse",
    rf"""WITH lists AS ({_LIST_SQL}),
    e AS (SELECT source, 0 AS form, unnest(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)\s*[-–—:]\s*([^\n]+)', 1)) AS name, unnest(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)\s*[-–—:]\s*([^\n]+)', 2)) AS url,
      trim(unnest(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)\s*[-–—:]\s*([^\n]+)', 3))) AS description FROM lists
     UNION ALL SELECT source, 1, unnest(regexp_extract_all(content, '\*\*([^*]+)\*\*\s*[-–—:]\s*([^\n]+)', 1)), '', trim(unnest(regexp_extract_all(content, '\*\*([^*]+)\*\*\s*[-–—:]\s*([^\n]+)', 2))) FROM lists)
    SELECT source, form, name, url, description FROM e""",
)
def list_entries_parse(spark, d):
    p = tables.table(spark, d, "part")
    line = F.concat(F.lit("- ["), "p_name", F.lit("](https://x.ai/"), F.col("p_partkey").cast("string"), F.lit(") - "), "p_type", F.lit(" api\n**"), "p_name", F.lit("** : "), "p_type")
    lists = p.groupBy(F.col("p_brand").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return tables.curated_list(lists).drop("pos")


@query("alias_resolve", f"WITH {S.VARIATIONS}, {S.RESOLVE}, q AS (SELECT * FROM " + S.values([(n,) for n in S.NAMES], "name") + f" UNION SELECT p_name FROM part) SELECT name, {S.resolved('name')} AS canonical FROM q")
def alias_resolve(spark, d):
    q = spark.createDataFrame([(n,) for n in S.NAMES], "name string").union(tables.table(spark, d, "part").select("p_name")).distinct()
    return resolve.resolve(q, "name", L.variations(spark)).select("name", "canonical")


@query(
    "alias_variations",
    f"""WITH {S.VARIATIONS}, parts AS (SELECT p_partkey AS ord, {S.normal('p_name')} AS key, CASE WHEN contains(p_name, 'ring') THEN 'LUMA LABS' WHEN contains(p_name, 'bolt') THEN 'Hey-Gen' ELSE p_name END AS display_name FROM part),
    form AS (SELECT {S.normal('variation')} AS form, arg_min(canonical, ord) AS matched FROM variations GROUP BY 1), r AS (SELECT * FROM parts LEFT JOIN form ON form = {S.normal('display_name')}),
    own AS (SELECT key, arg_max(display_name, ord) AS n FROM r WHERE matched IS NULL GROUP BY key),
    v AS (SELECT canonical, variation AS v FROM variations UNION SELECT matched, display_name FROM r WHERE matched IS NOT NULL UNION SELECT key, unnest([key, n, lower(n)]) FROM own)
    SELECT canonical, array_to_string(list_sort(list(DISTINCT v)), '|') AS variations FROM v GROUP BY canonical""",
)
def alias_variations(spark, d):
    name = F.col("p_name")
    shown = F.when(F.contains(name, F.lit("ring")), "LUMA LABS").when(F.contains(name, F.lit("bolt")), "Hey-Gen").otherwise(name)
    registry = tables.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), names.normalise(name).alias("key"), shown.alias("display_name"))
    return resolve.all_variations(L.variations(spark), registry).select("canonical", F.array_join("variations", "|").alias("variations"))


_REG = [(0, "Luma Labs", "video"), (1, "Hey Gen", "video"), (2, "luma ai", "image"), (3, "Claude", "text"), (4, "Cursor AI", "code"), (5, "small ring", "misc")]
_REG_SQL = "reg AS (SELECT * FROM " + S.values(_REG, "ord, name, category") + ")"


@query(
    "service_match",
    f"""WITH {S.VARIATIONS}, {S.RESOLVE}, {_REG_SQL}, q AS (SELECT * FROM {S.values([(n,) for n in S.NAMES], "query")} UNION SELECT p_name FROM part),
    rr AS (SELECT ord, name, category, {S.resolved('name')} AS canonical FROM reg), f AS (SELECT canonical, arg_min(name, ord) AS service_name, arg_min(category, ord) AS found FROM rr WHERE canonical IS NOT NULL GROUP BY canonical),
    qq AS (SELECT query, {S.resolved('query')} AS canonical FROM q)
    SELECT query, qq.canonical, service_name, CASE WHEN qq.canonical IS NOT NULL THEN coalesce(found, 'general') END AS category FROM qq LEFT JOIN f USING (canonical)""",
)
def service_match(spark, d):
    q = spark.createDataFrame([(n,) for n in S.NAMES], "query string").union(tables.table(spark, d, "part").select("p_name")).distinct()
    return resolve.match_services(q, spark.createDataFrame(_REG, "ord int, name string, category string"), L.variations(spark))


_SHOWN = "CASE WHEN contains(p_name, 'ring') THEN 'LUMA LABS' WHEN contains(p_name, 'bolt') THEN 'Hey-Gen' ELSE p_name END"


@query(
    "display_name",
    f"""WITH {S.VARIATIONS}, {S.RESOLVE}, reg AS (SELECT min(p_partkey) AS ord, {_SHOWN} AS name FROM part GROUP BY 2), rr AS (SELECT ord, name, {S.resolved('name')} AS canonical FROM reg),
    k AS (SELECT DISTINCT canonical FROM variations UNION SELECT {S.normal('p_name')} FROM part) SELECT canonical, coalesce((SELECT arg_min(name, ord) FROM rr WHERE rr.canonical = k.canonical), (SELECT arg_min(variation, ord) FROM variations v WHERE v.canonical = k.canonical), canonical) AS display_name FROM k""",
)
def display_name(spark, d):
    """Keys of the fixed spellings and of a registry of parts, as that registry shows them."""
    v, p = L.variations(spark), tables.table(spark, d, "part")
    name = F.col("p_name")
    shown = F.when(F.contains(name, F.lit("ring")), "LUMA LABS").when(F.contains(name, F.lit("bolt")), "Hey-Gen").otherwise(name)
    keys = v.select("canonical").union(p.select(names.normalise(name))).distinct()
    return resolve.display_names(keys, p.select(F.col("p_partkey").alias("ord"), shown.alias("name")), v)


_AGG_ALIASES = f"list_sort(list_distinct(list_concat(list(DISTINCT lower(name)), [{S.canonical('any_value(name)')}])))"


@query(
    "registry_fold",
    f"""WITH {S.SERVICES}, s AS (SELECT *, {S.canonical('name')} AS canonical_name FROM services)
    SELECT canonical_name, arg_min(name, ord) AS display_name, arg_min(category, ord) AS category, arg_min(url, ord) AS url, first(description ORDER BY length(description) DESC, ord) AS description,
      array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, array_to_string({_AGG_ALIASES}, '|') AS aliases, min(ord) AS ord FROM s GROUP BY canonical_name""",
)
def registry_fold(spark, d):
    return registry.fold(tables.services(spark, d)).withColumns({"sources": F.array_join("sources", "|"), "aliases": F.array_join("aliases", "|")})


@query("registry_in_order", f"WITH {S.SERVICES} SELECT DISTINCT lower(name) AS low, {S.canonical('name')} AS canonical_name FROM services")
def registry_in_order(spark, d):
    return registry.fold_in_order(tables.services(spark, d))


@query(
    "registry_by_category",
    f"""WITH {S.SERVICES}, u AS (SELECT name, arg_min(category, ord) AS category, min(ord) AS ord FROM services GROUP BY name), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS rn FROM u)
    SELECT category, count(*) AS n, string_agg(name, ', ' ORDER BY ord) FILTER (WHERE rn <= 3) AS examples, greatest(count(*) - 3, 0) AS n_more FROM r GROUP BY category""",
)
def registry_by_category(spark, d):
    u = tables.services(spark, d).groupBy("name").agg(F.min_by("category", "ord").alias("category"), F.min("ord").alias("ord"))
    n = u.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = resolve.first_rows(u, ["category"], ["ord"], 3).groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("examples"))
    return n.join(top, "category").select("category", "n", "examples", F.greatest(F.col("n") - 3, F.lit(0)).cast("long").alias("n_more"))


#: Names of the part table that stand in for priority services, and its categories for video, audio and image.
PRIORITY = ("ring", "gear")


def _plan_services(spark, d):
    c = F.when(F.col("category") == "promo", "video").when(F.col("category") == "small", "image").otherwise(F.col("category"))
    return tables.services(spark, d).withColumn("category", c)


def _plan_sql(max_queries, use_all):
    tpl = "templates" if use_all else "(SELECT pattern_type, min(template_ord) AS template_ord, arg_min(pattern, template_ord) AS pattern FROM templates GROUP BY pattern_type)"
    return f"""WITH {S.SERVICES}, {S.TEMPLATES}, c AS (SELECT ord, name, CASE category WHEN 'promo' THEN 'video' WHEN 'small' THEN 'image' ELSE category END AS category FROM services),
    t AS (SELECT *, CASE WHEN {S.any_of('lower(name)', PRIORITY)} THEN 0 WHEN category IN ('video', 'audio') THEN 1 WHEN category = 'image' THEN 2 ELSE 3 END AS tier FROM c),
    top AS (SELECT * FROM t ORDER BY tier, ord LIMIT {max(1, max_queries // (20 if use_all else 5))}),
    q AS (SELECT name AS service, {S.canonical('name')} AS service_key, category, replace(pattern, '{{service}}', name) AS query, pattern_type,
      CASE tier WHEN 0 THEN 'ultra' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE CASE WHEN (SELECT min(tier) FROM t) < 3 THEN 'normal' ELSE 'medium' END END AS priority, tier, ord, template_ord FROM top, {tpl})
    SELECT service, service_key, category, query, '{L.SEARCH_BASE}' || replace(replace(query, ' ', '+'), '"', '%22') AS query_url, pattern_type, priority, tier, ord, template_ord FROM q ORDER BY tier, ord, template_ord LIMIT {max_queries}"""


@query("query_plan", _plan_sql(100, False))
def query_plan(spark, d):
    return registry.plan_queries(_plan_services(spark, d), L.templates(spark), max_queries=100, priority=PRIORITY)


@query("query_plan_all_patterns", _plan_sql(210, True))
def query_plan_all_patterns(spark, d):
    return registry.plan_queries(_plan_services(spark, d), L.templates(spark), max_queries=210, use_all=True, priority=PRIORITY)


@query("query_plan_topn", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service, service_key ORDER BY ord, template_ord) AS rn FROM ({_plan_sql(210, True)})) WHERE rn <= 2 AND priority = 'ultra'")
def query_plan_topn(spark, d):
    from pyspark.sql import Window

    q = query_plan_all_patterns(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("service", "service_key").orderBy("ord", "template_ord")).cast("long"))
    return q.where((F.col("rn") <= 2) & (F.col("priority") == "ultra"))


@query(
    "query_coverage",
    f"WITH {S.SERVICES}, {S.TEMPLATES}, q AS (SELECT name AS service, count(*) AS n FROM services, templates GROUP BY name) SELECT service, CAST(sum(n) AS BIGINT) AS n_queries, CAST(sum(least(n, 20)) AS BIGINT) AS n_run, CAST(sum(n - least(n, 20)) AS BIGINT) AS n_left FROM q GROUP BY ROLLUP (service)",
)
def query_coverage(spark, d):
    """The queries that all templates make of all services, and how many a limit of twenty a service leaves."""
    q = tables.services(spark, d).select(F.col("name").alias("service")).crossJoin(F.broadcast(L.templates(spark).select("pattern")))
    return registry.coverage(q, 20)


@query("query_summary", f"SELECT priority, category, pattern_type, count(*) AS n, count(DISTINCT service) AS n_services FROM ({_plan_sql(210, True)}) GROUP BY GROUPING SETS ((priority), (category), (pattern_type))")
def query_summary(spark, d):
    return registry.query_summary(query_plan_all_patterns(spark, d))


# --- both sides from tables

_SPELLED = """spelled AS (SELECT regexp_replace(p_name, '[^a-z0-9]', '', 'g') AS canonical, p_name AS variation, min(p_partkey) AS ord FROM part GROUP BY ALL
      UNION ALL SELECT regexp_replace(p_name, '[^a-z0-9]', '', 'g'), p_name || ' ' || p_size, 1000000000 + min(p_partkey) FROM part GROUP BY ALL
      UNION ALL SELECT 'brand' || substr(p_brand, 7), p_brand, 2000000000 + min(p_partkey) FROM part GROUP BY ALL)"""


def _spelled(spark, d):
    """(ord, canonical, variation) of every part's name, of its name with its size, and of its brand."""
    p = tables.table(spark, d, "part")
    form = F.regexp_replace("p_name", "[^a-z0-9]", "")
    forms = (form, F.col("p_name")), (form, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))), (F.concat(F.lit("brand"), F.substring("p_brand", 7, 9)), F.col("p_brand"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), c.alias("canonical"), v.alias("variation")) for i, (c, v) in enumerate(forms)))).alias("s")
    rows = p.select("p_partkey", each).groupBy("s").agg(F.min("p_partkey").alias("first"))
    return rows.select((F.col("s.kind") * 1_000_000_000 + F.col("first")).alias("ord"), "s.canonical", "s.variation")


@query(
    "alias_resolve_tables",
    f"""WITH {_SPELLED}, q AS (SELECT DISTINCT p_name || ' by ' || p_brand AS name FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer),
    exact AS (SELECT lower(variation) AS alias, canonical, ord * 4 AS pos FROM spelled UNION ALL SELECT {S.normal('variation')}, canonical, ord * 4 + 1 FROM spelled), aliases AS (SELECT alias, arg_max(canonical, pos) AS canonical FROM exact GROUP BY alias)
    SELECT name, coalesce((SELECT canonical FROM aliases WHERE alias = lower(name)), (SELECT canonical FROM aliases WHERE alias = {S.normal('name')}),
      (SELECT arg_min(canonical, ord) FROM spelled WHERE contains(lower(name), lower(variation)) OR contains(lower(variation), lower(name)))) AS canonical FROM q""",
)
def alias_resolve_tables(spark, d):
    """Names that hold a spelling or that one holds, both from tables: they meet through the index of grams."""
    p = tables.table(spark, d, "part")
    q = p.select(F.concat("p_name", F.lit(" by "), "p_brand").alias("name")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(2))))
    q = q.union(tables.table(spark, d, "supplier").select("s_name")).union(tables.table(spark, d, "customer").select("c_name")).distinct()
    return resolve.resolve(q, "name", _spelled(spark, d)).select("name", "canonical")


@query(
    "mention_spellings",
    """WITH named AS (SELECT DISTINCT p_name AS canonical FROM part), a AS (SELECT canonical, canonical AS spelling FROM named UNION SELECT canonical, unnest(string_split(canonical, ' ')) FROM named)
    SELECT canonical, count(*) AS n_docs, sum(doc_id)::BIGINT AS ids FROM (SELECT DISTINCT doc_id, canonical FROM documents JOIN a ON contains(lower(text), lower(spelling))) GROUP BY canonical""",
)
def mention_spellings(spark, d):
    """How many documents mention each part, by its name or a word of it: all spellings in one pass over each text."""
    named = tables.table(spark, d, "part").select(F.col("p_name").alias("canonical")).distinct()
    aliases = named.select("canonical", F.explode(F.array_append(F.split("canonical", " "), F.col("canonical"))).alias("spelling"))
    found = resolve.mentions_of(tables.table(spark, d, "documents").select("doc_id", "text"), "text", aliases)
    return found.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("ids"))
