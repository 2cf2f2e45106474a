"""Queries on state files, configurations and presentation: written to the shared folder and read back where files are the point."""

from __future__ import annotations

from pyspark.sql import functions as F

from loresmith.api import KnowledgeBase, format_parameters
from loresmith.functions import names
from loresmith.operators import ordered, render
from loresmith.plans import sql as S
from loresmith.plans.catalogue import query
from loresmith.plans.entry_queries import _MERGED, DAY, _tree
from loresmith.sources import shared, state, tables

_EVENT_ITEMS = f"WITH {S.ITEMS} "


def _table(spark, d, name):
    return tables.table(spark, d, name)


@query(
    "news_threads",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
    SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY nth)) AS content_md5, count(*) - 1 AS n_comments FROM t WHERE nth = 1 OR (nth <= 11 AND length(text) > 100) GROUP BY conv_id""",
)
def news_threads(spark, d):
    """Stories with their first ten comments, of those the longer ones."""
    t = tables.thread_posts(tables.threads(spark, d), first=10, longer_than=100)
    return t.select("conv_id", F.md5("full_content").alias("content_md5"), "n_comments")


@query("readme_heads", "SELECT CASE WHEN contains(repo, '/') THEN repo ELSE 'dair-ai/' || repo END AS repo, md5(substr(text, 1, 3000)) AS head_md5 FROM (SELECT CASE WHEN n_chars > 800 THEN lang || '/' || source ELSE source END AS repo, text FROM documents)")
def readme_heads(spark, d):
    f = _table(spark, d, "documents").select(F.when(F.col("n_chars") > 800, F.concat("lang", F.lit("/"), "source")).otherwise(F.col("source")).alias("repo"), F.col("text").alias("content"))
    return state.repo_readme(f).select("repo", F.md5("content").alias("head_md5"))


#: Configurations of fifty suppliers each: forums first, then code hosts; a supplier's nation and balance name its host, priority and models.
_CONFIG = """c AS (SELECT s_suppkey // 50 AS path, s_suppkey AS k, s_name, CASE WHEN s_nationkey % 3 = 0 THEN 'github' ELSE 'reddit' END AS source_type,
    CASE WHEN s_acctbal > 5000 THEN 'high' WHEN s_acctbal > 0 THEN 'low' END AS priority, CASE s_nationkey % 3 WHEN 1 THEN 'general' WHEN 2 THEN CASE WHEN s_acctbal > 2000 THEN 'gpt' ELSE 'llama' END END AS model FROM supplier),
  src AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY source_type DESC, k) - 1 AS ord, source_type, priority, model, CASE source_type WHEN 'reddit' THEN 'r/' ELSE '' END || s_name AS name,
    CASE source_type WHEN 'reddit' THEN 'https://reddit.com/r/' ELSE 'https://github.com/acme/' END || s_name || '/' AS url FROM c)"""


def _configs(spark, d):
    s = _table(spark, d, "supplier")
    lit, c = F.lit, F.concat
    forum = F.col("s_nationkey") % 3 != 0
    name = c(F.when(forum, "r/").otherwise(""), "s_name")
    url = c(F.when(forum, "https://reddit.com/r/").otherwise("https://github.com/acme/"), "s_name", lit("/"))
    priority = F.when(F.col("s_acctbal") > 5000, ", priority: high").when(F.col("s_acctbal") > 0, ", priority: low").otherwise("")
    models = F.when(F.col("s_nationkey") % 3 == 1, ", models: [general]").when(forum & (F.col("s_acctbal") > 2000), ", models: [gpt]").when(forum, ", models: [llama]").otherwise("")
    line = c(lit("    - {name: '"), name, lit("', url: '"), url, lit("'"), priority, models, lit("}\n"))
    lines = lambda mine: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("s_suppkey", line.alias("line"))))), lambda x: x["line"]), "")
    text = c(lit("reddit:\n  sources:\n"), lines(forum), lit("github:\n  sources:\n"), lines(~forum))
    return tables.source_configs(s.groupBy(F.floor(F.col("s_suppkey") / 50).alias("path")).agg(text.alias("content")))


@query("source_config", f"WITH {_CONFIG} SELECT path, ord, source_type, name, url, priority, model AS models FROM src")
def source_config(spark, d):
    """YAML files of the suppliers as sources, parsed in tasks."""
    return _configs(spark, d).select("path", "ord", "source_type", "name", "url", "priority", F.get("models", F.lit(0)).alias("models"))


@query("source_priority", f"WITH {_CONFIG} SELECT name FROM src WHERE priority = 'high'")
def source_priority(spark, d):
    return state.by_priority(_configs(spark, d)).select("name")


@query("source_models", f"WITH {_CONFIG} SELECT name FROM src WHERE source_type = 'github' OR model IN ('general', 'gpt')")
def source_models(spark, d):
    return state.for_model(_configs(spark, d), "gpt").select("name")


@query("default_sources", f"WITH {_CONFIG}, t AS (SELECT * FROM src WHERE priority = 'high' ORDER BY path, ord LIMIT 5) SELECT CASE source_type WHEN 'reddit' THEN 'reddit:' || substr(name, 3) ELSE 'github:' || regexp_extract(url, 'github\\.com/(.*)/', 1) END AS source FROM t")
def default_sources(spark, d):
    return spark.createDataFrame([(n,) for n in state.default_sources(_configs(spark, d))], "source string")


@query("source_lookup", f"WITH {_CONFIG}, a AS (SELECT DISTINCT s_name AS query FROM supplier UNION SELECT DISTINCT source FROM documents), s AS (SELECT lower(regexp_replace(name, '^r/', '')) AS k, arg_min(url, path * 100 + ord) AS url FROM src GROUP BY 1) SELECT query, url FROM a LEFT JOIN s ON k = lower(query)")
def source_lookup(spark, d):
    """Addresses of the suppliers' sources, by their names without "r/", and of names that no configuration has."""
    known = _configs(spark, d).select((F.col("path") * 100 + F.col("ord")).alias("ord"), "name", "url")
    asked = _table(spark, d, "supplier").select(F.col("s_name").alias("query")).union(_table(spark, d, "documents").select("source")).distinct()
    return state.source_of(known, asked).select("query", "url")


@query("source_dispatch", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN n_chars > 1500 THEN 'reddit' WHEN n_chars > 700 THEN 'github' END AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY kind")
def source_dispatch(spark, d):
    n = F.col("n_chars")
    name = _table(spark, d, "documents").select(F.concat(F.when(n > 1500, "reddit:").when(n > 700, "github:").otherwise("other:"), "source").alias("s"))
    return name.select(names.source_kind(F.col("s")).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("hub_services", "SELECT ''::VARCHAR AS name WHERE FALSE")
def hub_services(spark, d):
    """A source that lists nothing."""
    return state.hub_services(spark).select("name")


#: A catalogue's models: parts by brand and name, so that many come several times; some without length or name.
_MODELS = """m AS (SELECT p_partkey // 100 AS page, p_partkey AS k, p_brand || '/' || p_name AS model_id, CASE WHEN p_size % 5 <> 0 THEN p_size * 4096 END AS len, CASE WHEN p_size % 2 = 0 THEN p_type END AS name,
    CASE WHEN p_size % 3 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS price FROM part),
  k AS (SELECT model_id, min(k) AS first, coalesce(arg_max_null(len, k), 4096) AS context_length, coalesce(arg_max_null(name, k), model_id) AS name, arg_max(price, k) AS price FROM m GROUP BY model_id)"""


def _contexts(spark, d):
    """Contexts of a catalogue of parts, in pages of a hundred."""
    size = F.col("p_size")
    price = F.create_map(F.lit("prompt"), F.when(size % 3 == 0, "0").otherwise(size.cast("string")))
    model = F.struct(
        F.concat("p_brand", F.lit("/"), "p_name").alias("id"), F.when(size % 5 != 0, size * 4096).alias("context_length"), F.when(size % 2 == 0, F.col("p_type")).alias("name"), price.alias("pricing")
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(model).alias("m")))), lambda x: x["m"]), ",")
    pages = _table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.concat(F.lit('{"data": ['), rows, F.lit("]}")).alias("content"))
    return state.catalogue_contexts(pages)


@query("model_contexts", f"WITH {_MODELS} SELECT model_id, context_length, name, price FROM k")
def model_contexts(spark, d):
    """A catalogue's pages as contexts, written from the tasks as a file of rows and read back."""
    path = shared.folder(spark, "contexts")
    found = _contexts(spark, d).select("model_id", "context_length", "name", "pricing")
    found.write.json(path)
    return spark.read.schema(found.schema).json(path).select("model_id", "context_length", "name", F.element_at("pricing", "prompt").alias("price"))


@query("context_stats", f"WITH {_MODELS} SELECT count(*) AS models, count(*) FILTER (WHERE context_length > 100000) AS large, count(*) FILTER (WHERE price = '0') AS free FROM k")
def context_stats(spark, d):
    return state.context_stats(_contexts(spark, d))


@query("largest_contexts", f"WITH {_MODELS} SELECT model_id, context_length FROM k WHERE context_length > 100000 ORDER BY context_length DESC, model_id LIMIT 5")
def largest_contexts(spark, d):
    return state.largest_contexts(_contexts(spark, d)).select("model_id", "context_length")


def _results(spark, d):
    """Extraction results by service: (service, four lists, batch_size, error)."""
    e = _table(spark, d, "events")
    pick = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("props")))).alias(name)
    r = e.groupBy(F.concat(F.lit("Svc"), F.col("user_id").cast("string")).alias("service")).agg(
        pick("error", "problems"), pick("click", "tips"), pick("purchase", "cost_info"), pick("view", "settings"), F.count(F.lit(1)).alias("batch_size")
    )
    return r.withColumn("error", F.when(F.size("problems") > 2, "many"))


@query(
    "run_report",
    "SELECT count(*) AS queries_run, count(*) FILTER (WHERE p <= 2) AS successful_queries, count(*) FILTER (WHERE p > 2) AS failed_queries, CAST(sum(n) AS BIGINT) AS total_posts_scraped FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS p FROM events GROUP BY user_id)",
)
def run_report(spark, d):
    return state.run_report(_results(spark, d), DAY).select("queries_run", "successful_queries", "failed_queries", "total_posts_scraped")


@query("extraction_results", f"{_EVENT_ITEMS}, x AS (SELECT service, list_name, count(*) AS n FROM items i JOIN events e ON e.event_id = i.ord WHERE event_type IN ('error', 'click', 'purchase', 'view') GROUP BY ALL) SELECT * FROM x")
def extraction_results(spark, d):
    """Run reports written as JSON and scanned again: items by service and list."""
    path = shared.folder(spark, "run")
    state.run_report(_results(spark, d).drop("error").withColumn("error", F.lit(None).cast("string")), DAY).write.json(path)
    return state.extraction_results(spark, path).where("item is not null").groupBy("service", "list_name").agg(F.count(F.lit(1)).alias("n"))


@query("registry_roundtrip", "SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS canonical_name, min(p_name) AS display_name, count(DISTINCT lower(p_name)) AS n_aliases FROM part GROUP BY 1")
def registry_roundtrip(spark, d):
    """A registry written as its JSON document and scanned again."""
    path = shared.folder(spark, "registry")
    p = _table(spark, d, "part").groupBy(names.normalise(F.col("p_name")).alias("canonical_name")).agg(F.min("p_name").alias("display_name"), F.array_sort(F.collect_set(F.lower("p_name"))).alias("aliases"))
    none = F.lit("")
    registry = p.withColumns({"category": none, "description": none, "url": none, "sources": F.array(F.lit("s"))})
    state.registry_json(registry, DAY).write.json(path)
    return tables.registry_file(spark, path).select("canonical_name", "display_name", F.size("aliases").cast("long").alias("n_aliases"))


@query("update_log_scan", "SELECT 'svc' || user_id AS service_key, count(*) AS total FROM events GROUP BY ALL")
def update_log_scan(spark, d):
    """An update log written as its JSON document and scanned again."""
    path = shared.folder(spark, "log")
    e = _table(spark, d, "events").groupBy(F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("k")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = F.struct(F.col("n").alias("tips"), F.lit(0).alias("problems"))
    entry = F.struct("k", F.struct(F.lit(DAY).alias("timestamp"), counts.alias("content_counts"), F.lit("h").alias("content_hash")))
    e.agg(F.map_from_entries(F.collect_list(entry)).alias("services")).write.json(path)
    return state.update_log(spark, path).select("service_key", "total")


_FILES = f"""(WITH {_MERGED} SELECT lower(service) AS slug, f AS file FROM merged, (VALUES ('prompting.md'), ('parameters.json'), ('pitfalls.md'), ('cost_optimization.md'), ('metadata.json')) AS t(f)
    WHERE CASE f WHEN 'prompting.md' THEN len(tips) + len(settings) > 0 WHEN 'parameters.json' THEN len(settings) + len(cost_info) > 0 WHEN 'pitfalls.md' THEN len(problems) > 0 OR len(list_filter(cost_info, lambda x: contains(lower(x), 'limit'))) > 0
      WHEN 'cost_optimization.md' THEN len(cost_info) > 0 OR len(list_filter(tips, lambda x: contains(lower(x), 'free') OR contains(lower(x), 'unlimited'))) > 0 ELSE TRUE END)"""


@query("corpus_roundtrip", f"SELECT slug, file FROM {_FILES}")
def corpus_roundtrip(spark, d):
    """The document tree written from the executors and scanned again; rows whose content came back unchanged."""
    path = shared.folder(spark, "tree")
    tree = ordered.written(spark, _tree(spark, d), f"{path}-rows")  # rendered once, as it is read twice
    render.write_files(tree, path)
    back = render.read_files(spark, path).select("slug", "file", F.md5(F.regexp_replace("content", r"\n+\z", "")).alias("m"))
    return tree.select("slug", "file", F.md5(F.regexp_replace("content", r"\n+\z", "")).alias("m")).join(back, ["slug", "file", "m"]).select("slug", "file")


@query("kb_entries", f"SELECT DISTINCT 'general' AS category, slug AS name FROM {_FILES}")
def kb_entries(spark, d):
    return KnowledgeBase(spark, _tree(spark, d)).list_entries()


@query("kb_counts", f"SELECT category, count(*) AS n FROM (SELECT DISTINCT 'general' AS category, slug FROM {_FILES}) GROUP BY ROLLUP (category)")
def kb_counts(spark, d):
    return KnowledgeBase(spark, _tree(spark, d)).counts()


@query("kb_export", f"SELECT 'general' AS category, count(DISTINCT slug || '/' || file) AS n_files FROM {_FILES}")
def kb_export(spark, d):
    """The markdown export, by the headings of its files."""
    e = KnowledgeBase(spark, _tree(spark, d)).export("markdown")
    return e.select("category", F.size(F.regexp_extract_all("content", F.lit(r"(?m)^## svc\d+ / [a-z_]+\.(?:md|json)$"), F.lit(0))).cast("long").alias("n_files"))


@query("commit_message", "WITH n AS (SELECT DISTINCT source FROM documents ORDER BY source), c AS (SELECT count(*) AS k, (SELECT string_agg('- ' || source, chr(10) ORDER BY source) FROM (SELECT source FROM n LIMIT 10)) AS l, string_agg(source, ', ' ORDER BY source) AS few FROM n) SELECT CASE WHEN k <= 3 THEN 'docs: Update ' || few || ' documentation' ELSE 'docs: Update ' || k || ' service documentations' END || chr(10) || chr(10) || 'Updated services:' || chr(10) || l || CASE WHEN k > 10 THEN chr(10) || '- ... and ' || (k - 10) || ' more' ELSE '' END || chr(10) || chr(10) || 'Extraction date: 2024-02-01' AS message FROM c")
def commit_message(spark, d):
    m = state.commit_message(_table(spark, d, "documents").select(F.col("source").alias("entity")), DAY)
    return spark.createDataFrame([(m,)], "message string")


# --- presentation




@query("parameter_cards", "SELECT p_partkey, CASE WHEN p_size > 20 THEN '### ' || p_name || chr(10) || '- Default: ' || p_size || chr(10) || '- ' || p_type || chr(10) ELSE '### Recommended Settings' || chr(10) || '- ' || p_name || chr(10) || chr(10) || '### Cost Optimization' || chr(10) || '- Pricing: ' || p_size || chr(10) || '- ' || p_type || chr(10) END AS card FROM part")
def parameter_cards(spark, d):
    """Parameters as markdown, from a list and from an object; the unlimited option is not shown."""
    p = _table(spark, d, "part")
    listed = F.to_json(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("default_value"), F.col("p_type").alias("description"))))
    settings = F.struct(F.struct(F.col("p_name").alias("description")).alias("setting_0"))
    costs = F.struct(F.col("p_size").cast("string").alias("pricing"), F.col("p_type").alias("tip_1"), F.lit("all").alias("unlimited_option"))
    obj = F.to_json(F.struct(settings.alias("recommended_settings"), costs.alias("cost_optimization")))
    return p.select("p_partkey", format_parameters(F.when(F.col("p_size") > 20, listed).otherwise(obj)).alias("card"))


@query(
    "practice_cards",
    """SELECT p_partkey, '# ' || p_name || ' Best Practices' || chr(10) || chr(10) || CASE WHEN p_size > 10 THEN '## Prompting Guide' || chr(10) || chr(10) || p_type || chr(10) || chr(10) ELSE '' END ||
    CASE WHEN p_size > 25 THEN '## Parameters' || chr(10) || chr(10) || '### ' || p_brand || chr(10) || chr(10) || chr(10) ELSE '' END || '## Common Pitfalls' || chr(10) || chr(10) || '### ' || p_brand || chr(10) || p_type || chr(10) ||
    CASE WHEN p_size > 30 THEN '**Solution:** ' || p_name || chr(10) ELSE '' END || chr(10) AS card FROM part""",
)
def practice_cards(spark, d):
    p, big = _table(spark, d, "part"), lambda n, c: F.when(F.col("p_size") > n, c)
    pit = F.array(F.struct(F.col("p_brand").alias("title"), F.col("p_type").alias("description"), big(30, F.col("p_name")).alias("solution")))
    params = big(25, F.array(F.struct(F.col("p_brand").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    j = F.to_json(F.struct(big(10, F.col("p_type")).alias("prompt_structure"), params.alias("parameters"), pit.alias("pitfalls")))
    return p.select("p_partkey", render.practice_card(F.col("p_name"), j).alias("card"))


@query("setting_text", "SELECT event_id, 'mode = ' || event_type AS setting FROM events")
def setting_text(spark, d):
    return _table(spark, d, "events").select("event_id", names.setting_text(F.create_map(F.lit("mode"), F.col("event_type")))[0].alias("setting"))


@query("markdown_html", "SELECT p_partkey, '<h2>' || p_name || '</h2>' || chr(10) || '<p><strong>' || p_type || '</strong> is <code>' || p_size || '</code><br/>and <a href=\"http://x.org\" target=\"_blank\" rel=\"noopener\">more</a></p>' || chr(10) || '<ul><li>one</li>' || chr(10) || '<li>' || p_brand || '</li></ul>' AS html FROM part")
def markdown_html(spark, d):
    c, lit = F.concat, F.lit
    md = c(lit("## "), "p_name", lit("\n\n**"), "p_type", lit("** is `"), F.col("p_size").cast("string"), lit("`\nand [more](http://x.org)\n\n- one\n* "), "p_brand")
    return _table(spark, d, "part").select("p_partkey", render.markdown_html(md).alias("html"))


@query("json_html", """SELECT p_partkey, replace('<pre class="code-block json">{~  <span class="json-key">"a"</span>: <span class="json-string">"&lt;' || p_name || '&gt;"</span>,~  <span class="json-key">"n"</span>: <span class="json-number">' || p_size || '</span>,~  <span class="json-key">"x"</span>: <span class="json-null">null</span>~}</pre>', '~', chr(10)) AS html FROM part""")
def json_html(spark, d):
    j = F.concat(F.lit('{"a":"<'), "p_name", F.lit('>","n":'), F.col("p_size").cast("string"), F.lit(',"x":null}'))
    return _table(spark, d, "part").select("p_partkey", render.json_html(j).alias("html"))


