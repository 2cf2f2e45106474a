"""Queries on posts, threads, texts and their quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loresmith.functions import chunk_tables, lookups as L
from loresmith.functions import names, text
from loresmith.operators import merge, pack
from loresmith.plans import sql as S
from loresmith.plans.catalogue import query
from loresmith.sources import html, tables

AS_OF = "2024-02-01 00:00:00"


def _docs(spark, d):
    return tables.table(spark, d, "documents")


@query("post_scan_truncate", f"WITH {S.POSTS} SELECT post_id, title, content, community, score, substr(content, 1, 100) AS shown FROM posts")
def post_scan_truncate(spark, d):
    return tables.posts(spark, d).withColumn("shown", F.substring("content", 1, 100))


@query(
    "thread_assemble",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
    SELECT conv_id, max(text) FILTER (WHERE nth = 1) AS body, count(*) FILTER (WHERE nth > 1 AND length(text) > 50) AS n_comments,
      string_agg(text, chr(10) || chr(10) ORDER BY nth) FILTER (WHERE nth = 1 OR length(text) > 50) AS full_content FROM t WHERE nth <= 6 GROUP BY conv_id""",
)
def thread_assemble(spark, d):
    return tables.thread_posts(tables.threads(spark, d))


@query("html_items")
def html_items(spark, d):
    return html.html_items(tables.table(spark, d, "pages"))


@query(
    "relevant_posts",
    f"""WITH {S.POSTS} SELECT post_id, score FROM posts LEFT JOIN labels ON doc_id = post_id WHERE score >= 10 AND coalesce(quality, 0) >= 0.5
    AND {S.any_of("lower(content || title || CASE WHEN score > 400 THEN ' How to' WHEN score > 200 THEN ' CONFIG' ELSE '' END)", L.RELEVANT_WORDS)}""",
)
def relevant_posts(spark, d):
    p = tables.posts(spark, d).join(tables.table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), "quality"), "post_id", "left")
    flair = F.when(F.col("score") > 400, " How to").when(F.col("score") > 200, " CONFIG").otherwise("")  # invented texts hold none of the words
    hay = F.lower(F.concat("content", F.coalesce("title", F.lit("")), flair))
    return p.where((F.col("score") >= 10) & (F.coalesce("quality", F.lit(0)) >= 0.5) & L.holds(hay, L.RELEVANT_WORDS)).select("post_id", "score")


@query("confident_practices", "SELECT event_id, value FROM events WHERE coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 20 END, 0.5) >= 0.6")
def confident_practices(spark, d):
    e = tables.table(spark, d, "events")
    c = F.when(F.col("event_id") % 7 != 0, F.col("value") / 20)
    return e.where(F.coalesce(c, F.lit(0.5)) >= 0.6).select("event_id", "value")


@query("unseen_posts", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unseen_posts(spark, d):
    return _docs(spark, d).select("doc_id").join(tables.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("seen_posts", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def seen_posts(spark, d):
    return _docs(spark, d).select("doc_id", "n_chars").join(tables.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    "dedup_ci",
    r"SELECT lang, text, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def dedup_ci(spark, d):
    return merge.dedup_ordered(_docs(spark, d).select("lang", "text", "doc_id"), ["lang"], "text", "doc_id")


@query("dedup_md5", "SELECT doc_id, md5(text) AS content_md5 FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_md5(spark, d):
    return merge.dedup_md5(_docs(spark, d).select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("content_md5"))


@query(
    "dedup_merge_ids",
    "SELECT md5(lower(split_part(text, chr(10), 1))) AS key, arg_min(split_part(text, chr(10), 1), doc_id) AS problem, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS ids, array_to_string(list_sort(list_distinct(flatten(list([source, lang])))), ',') AS solutions FROM documents GROUP BY lower(split_part(text, chr(10), 1))",
)
def dedup_merge_ids(spark, d):
    rows = _docs(spark, d).select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("problem"), F.col("doc_id").alias("post_id"), F.array("source", "lang").alias("solutions"))
    found = merge.merge_ids(rows, "problem", "post_id", "post_id", ("solutions",))
    return found.select(F.md5("key").alias("key"), "problem", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.array_join("solutions", ",").alias("solutions"))


@query("theme_set", "SELECT lang AS practice_type, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang")
def theme_set(spark, d):
    return _docs(spark, d).where("lang <> ''").groupBy(F.col("lang").alias("practice_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "entity_union",
    "SELECT DISTINCT source AS doc, e AS entity FROM (SELECT source, unnest(['m:' || lang, 's:' || source, CASE WHEN n_chars > 500 THEN 'tool' END, CASE WHEN n_chars > 2000 THEN 'm:' || lang ELSE 'platform' END]) AS e FROM documents) WHERE e IS NOT NULL",
)
def entity_union(spark, d):
    of = lambda c: F.array_compact(F.array(c))
    chunk = _docs(spark, d).select(
        F.col("source").alias("doc"), of(F.concat(F.lit("m:"), "lang")).alias("models"), of(F.concat(F.lit("s:"), "source")).alias("services"), F.array(F.lit("technique")).alias("techniques"),
        of(F.when(F.col("n_chars") > 500, "tool")).alias("tools"), of(F.when(F.col("n_chars") > 2000, F.concat(F.lit("m:"), "lang")).otherwise("platform")).alias("platforms"),
    )
    return merge.entity_union(chunk, "doc")


@query(
    "run_summary",
    """SELECT count(*) AS posts, CAST(sum(n_chars) AS BIGINT) AS total_chars, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT source AS m FROM documents)) AS models,
    count(DISTINCT lang) AS n_themes, round(coalesce(avg(quality), 0), 6) AS mean_relevance FROM documents LEFT JOIN labels USING (doc_id)""",
)
def run_summary(spark, d):
    j = _docs(spark, d).select("doc_id", "n_chars", "source", "lang").join(tables.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("posts"), F.sum("n_chars").alias("total_chars"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("models"),
        F.count_distinct("lang").alias("n_themes"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("mean_relevance"),
    )


@query("token_count", "SELECT doc_id, length(text) // 4 AS n_tokens FROM documents")
def token_count(spark, d):
    return _docs(spark, d).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query("usable_tokens", "SELECT p_partkey, CASE WHEN p_size * 100 - 1700 < 1000 THEN greatest(1000, p_size * 100 - 1700) ELSE p_size * 100 - 1700 END AS batch_tokens, CASE WHEN p_size * 100 - 1500 < 1000 THEN greatest(500, p_size * 100 - 1500) ELSE p_size * 100 - 1500 END AS chunk_tokens FROM part")
def usable_tokens(spark, d):
    limit = F.col("p_size") * 100
    return tables.table(spark, d, "part").select("p_partkey", text.usable_tokens(limit, 1700, 1000).alias("batch_tokens"), text.usable_tokens(limit, 1500, 500).alias("chunk_tokens"))


@query("truncate_tokens", "SELECT doc_id, CASE WHEN length(text) // 4 <= 200 THEN text ELSE substr(text, 1, 803) || chr(10) || chr(10) || '[Content truncated...]' END AS text FROM documents")
def truncate_tokens(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate_tokens(F.col("text"), 200).alias("text"))


@query("batch_estimate", "SELECT doc_id, CAST(greatest(1, floor(0.8 * (2396 // greatest(length(text) // 4, 1)))) AS BIGINT) AS per_batch FROM documents")
def batch_estimate(spark, d):
    n = F.greatest(text.token_count(F.col("text")), F.lit(1).cast("long"))
    return _docs(spark, d).select("doc_id", F.greatest(F.lit(1), F.floor(0.8 * F.floor(2396 / n))).cast("long").alias("per_batch"))


_CHUNK = """WITH c AS (SELECT doc_id, text, length(text) AS n FROM documents),
  s AS (SELECT doc_id, text, n, unnest(range(0, n, 1800)) AS start_pos FROM c WHERE n > 2000),
  f AS (SELECT doc_id, min(start_pos) FILTER (WHERE start_pos > 0 AND least(start_pos + 2000, n) - start_pos < 500) AS short FROM s GROUP BY doc_id),
  k AS (SELECT s.*, short, row_number() OVER (PARTITION BY s.doc_id ORDER BY start_pos) - 1 AS chunk_index, lead(start_pos) OVER (PARTITION BY s.doc_id ORDER BY start_pos) AS next_pos FROM s JOIN f USING (doc_id) WHERE short IS NULL OR start_pos < short),
  e AS (SELECT *, CASE WHEN next_pos IS NULL AND short IS NOT NULL THEN least(short + 2000, n) ELSE least(start_pos + 2000, n) END AS end_pos FROM k)
  SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos,
    CAST((n - 2000) // 1800 + 1 + CASE WHEN (n - 2000) % 1800 > 0 THEN 1 ELSE 0 END AS BIGINT) AS total_chunks, CAST(CASE WHEN least(start_pos + 2000, n) < n THEN 200 ELSE 0 END AS BIGINT) AS overlap_with_next,
    md5(substr(text, start_pos + 1, end_pos - start_pos)) AS text_md5, substr(md5(start_pos || ':' || end_pos), 1, 8) AS chunk_id FROM e
  UNION ALL SELECT doc_id, 0, 0, n, 1, 0, md5(text), substr(md5('0:' || n), 1, 8) FROM c WHERE n <= 2000"""


@query("chunk_overlap", _CHUNK)
def chunk_overlap(spark, d):
    c = _docs(spark, d).select("doc_id", F.explode(text.overlap_chunks(F.col("text"), 2000, 200, 500)).alias("c")).select("doc_id", "c.*")
    return c.select(
        "doc_id", *(F.col(x).cast("long").alias(x) for x in ("chunk_index", "start_pos", "end_pos", "total_chunks", "overlap_with_next")), F.md5("text").alias("text_md5"), text.chunk_id(F.col("start_pos"), F.col("end_pos")).alias("chunk_id")
    )


def _fold(pieces: str, size: int, *, glue: str, carry: str, extra: int, whole: str, text: str = "text") -> str:
    """SQL of chunks folded from a document's pieces in order; texts under ``whole`` are one chunk.

    carry: what a new chunk begins with, given ``part``; extra: characters counted for a piece besides its own.
    """
    cut = f"(n + length(s.t) > {size} AND len(part) > 0)"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {text} AS text FROM documents), p AS (SELECT doc_id, {pieces} AS l FROM d WHERE NOT ({whole})),
  s AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM p),
  f(doc_id, i, part, n, done) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM p
    UNION ALL SELECT f.doc_id, f.i + 1, list_append(CASE WHEN {cut} THEN {carry} ELSE part END, s.t), CASE WHEN {cut} THEN CAST(coalesce(list_sum(list_transform({carry}, lambda x: length(x))), 0) AS BIGINT) ELSE n END + length(s.t) + {extra},
      CASE WHEN {cut} THEN array_to_string(part, {glue}) END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
  c AS (SELECT doc_id, i, done AS text FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, max(i) + 1, array_to_string(arg_max(part, i), {glue}) FROM f GROUP BY doc_id UNION ALL SELECT doc_id, 0, text FROM d WHERE {whole})
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, text FROM c"""


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_SECTIONS = r"string_split(regexp_replace(regexp_replace(text, '(?m)^(#{1,6}\s)', chr(1) || '\1', 'g'), '\n\n+', chr(1), 'g'), chr(1))"


def _chunks(kind, size, sql=None):
    @query(f"chunk_{kind}", sql)
    def run(spark, d):
        parted = _docs(spark, d) if kind == "sentences" else _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
        return pack.chunks(parted, kind, size=size, overlap=200, least=500)


_SENTENCE_FOLD = _fold(_SENTENCES, 1000, glue="' '", carry="CASE WHEN len(part) > 1 THEN [part[-1]] ELSE [] END", extra=0, whole="length(text) <= 1000")
_SECTION_FOLD = _fold(_SECTIONS, 2000, glue="chr(10) || chr(10)", carry="CAST([] AS VARCHAR[])", extra=2, whole="FALSE", text="replace(text, chr(10), chr(10) || chr(10))")
_MARKS = r"(\n---+\n|\n\n#{1,6}\s+|\n\n(?:```|~~~)|\n\n(?:\d+\.|\*|-)\s+|\n\n[\p{L}\p{N}_])"
_BOUNDARY_FOLD = f"""
  WITH RECURSIVE t AS (SELECT doc_id, text, string_split(regexp_replace(text, '{_MARKS}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS l FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL)),
  f(doc_id, i, cur, done) AS (SELECT doc_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM t WHERE len(l) > 1
    UNION ALL SELECT f.doc_id, i + 1, CASE WHEN length(cur) + length(l[2 * i + 1]) > 2000 THEN '' ELSE coalesce(cur, '') END || l[2 * i + 1] || l[2 * i + 2], CASE WHEN length(cur) + length(l[2 * i + 1]) > 2000 THEN cur END
    FROM f JOIN t ON t.doc_id = f.doc_id WHERE i < len(l) // 2),
  c AS (SELECT doc_id, i, done AS text FROM f WHERE done IS NOT NULL
    UNION ALL SELECT f.doc_id, max(i) + 1, arg_max(cur, i) || any_value(l[-1]) FROM f JOIN t ON t.doc_id = f.doc_id WHERE i > 0 GROUP BY f.doc_id
    UNION ALL SELECT doc_id, k, CASE WHEN length(text) <= 2000 OR length(text) - 1800 * (k + 1) < 500 THEN substr(text, 1800 * k + 1) ELSE substr(text, 1800 * k + 1, 2000) END
      FROM t, unnest(range(greatest(1, (length(text) - 500) // 1800 + 1))) AS u(k) WHERE len(l) = 1 AND (length(text) > 2000 OR k = 0))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, text FROM c"""

_chunks("sentences", 1000, _SENTENCE_FOLD)
_chunks("sections", 2000, _SECTION_FOLD)
_chunks("boundaries", 2000, _BOUNDARY_FOLD)


def _lateral(function, size, sql):
    @query(f"sql_{function}", sql)
    def run(spark, d):
        """The chunker as a table function in SQL, beside each document."""
        chunk_tables.register(spark)
        docs = _docs(spark, d) if function == "sentence_chunks" else _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
        return spark.sql(f"SELECT d.doc_id, c.chunk_index, c.total_chunks, c.text FROM {{docs}} d, LATERAL {function}(d.text, {size}) c", docs=docs)


_lateral("sentence_chunks", 1000, _SENTENCE_FOLD)
_lateral("section_chunks", 2000, _SECTION_FOLD)


@query("headers", r"SELECT doc_id, array_to_string((regexp_extract_all(regexp_replace('# ' || text, '\n', chr(10) || '## ', 'g'), '(?m)^#{1,6}\s+(.+)$', 1))[1:5], '|') AS heads FROM documents")
def headers(spark, d):
    md = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return _docs(spark, d).select("doc_id", F.array_join(text.headers(md), "|").alias("heads"))


def _fold_sql(service):
    return f"""WITH RECURSIVE {S.POSTS}, p AS (SELECT {service} AS service, post_id, content, length(title || content) // 4 AS cost, row_number() OVER (PARTITION BY {service} ORDER BY post_id) AS i FROM posts),
    f(service, i, held, is_open, next, batch, post_id, n_chars) AS (SELECT DISTINCT service, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM p
      UNION ALL SELECT f.service, p.i, CASE WHEN 100 + held + cost <= 1000 THEN held + cost WHEN cost <= 900 THEN cost ELSE 0 END, 100 + held + cost <= 1000 OR cost <= 900,
        CASE WHEN 100 + held + cost <= 1000 THEN next ELSE next + CAST(is_open AS INT) + CAST(cost > 900 AND content <> '' AS INT) END,
        CASE WHEN 100 + held + cost <= 1000 THEN next WHEN cost <= 900 OR content <> '' THEN next + CAST(is_open AS INT) END, p.post_id,
        length(content) + CAST(cost > 900 AND 100 + held + cost > 1000 AND NOT ends_with(content, '.') AS INT)
      FROM f JOIN p ON p.service = f.service AND p.i = f.i + 1)
    SELECT service, CAST(batch AS INT) AS batch, post_id, n_chars FROM f WHERE batch IS NOT NULL"""


def _costed(spark, d):
    return tables.posts(spark, d).select("post_id", F.col("community").alias("service"), "content", text.token_count(F.concat("title", "content")).alias("cost"))


@query("pack_batches", _fold_sql("community"))
def pack_batches(spark, d):
    return pack.pack_batches(_costed(spark, d), key="service", order="post_id", usable=1000, base=100).drop("content")


@query("pack_one_service", _fold_sql("'all'"))
def pack_one_service(spark, d):
    """All posts as one service's: its batches begin where pointers lead, in logarithmic rounds over all tasks."""
    p = _costed(spark, d).select(F.lit("all").alias("k"), F.col("post_id").alias("o"), "post_id", F.coalesce("content", F.lit("")).alias("content"), "cost")
    return pack.fold_by_pointers(p, 1000, 100).select(F.col("k").alias("service"), "batch", "post_id", F.length("content").cast("long").alias("n_chars"))


@query(
    "divided_posts",
    """WITH RECURSIVE big AS (SELECT doc_id, text, string_split(text, '. ') AS s FROM documents WHERE length(text) // 4 > 300 AND text <> ''),
    f(doc_id, s, i, part, used, body) AS (SELECT doc_id, s, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM big
      UNION ALL SELECT doc_id, s, i + 1, part + CAST(over AND body IS NOT NULL AS INT), CASE WHEN over THEN n ELSE used + n END, CASE WHEN over OR body IS NULL THEN s[i + 1] ELSE body || '. ' || s[i + 1] END
      FROM (SELECT *, (length(s[i + 1]) + 2) // 4 AS n, used + (length(s[i + 1]) + 2) // 4 > 100 AS over FROM f WHERE i < len(s))),
    parts AS (SELECT doc_id, part, arg_max(body, i) AS body, max(i) = len(any_value(s)) AS last FROM f WHERE body IS NOT NULL GROUP BY doc_id, part)
    SELECT doc_id AS post_id, part::INT AS batch, md5(CASE WHEN last AND ends_with(body, '.') THEN body ELSE body || '.' END) AS content_md5 FROM parts
    UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) // 4 <= 300""",
)
def divided_posts(spark, d):
    """Every document packed alone: those over the budget in parts of whole sentences, as an extractor is asked about them."""
    docs = tables.table(spark, d, "documents").where("text is not null").select("doc_id", F.col("doc_id").alias("post_id"), F.col("text").alias("content"), text.token_count(F.col("text")).alias("cost"))
    packed = pack.pack_batches(docs, key="doc_id", order="post_id", usable=400, base=100)
    return packed.select("post_id", "batch", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    "json_tolerant",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS object, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def json_tolerant(spark, d):
    e = tables.table(spark, d, "events")
    reply = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("so "), "props", F.lit(" done"))).otherwise(F.lit("no json"))
    j = text.json_object(reply)
    return e.select("event_id", j.alias("object"), F.get_json_object(j, "$.k").cast("long").alias("k"))


_MARKED = "CASE lang WHEN 'en' THEN text || chr(10) || chr(10) || 'Best Practices: ' || source || chr(10) || chr(10) || 'tip: x' WHEN 'de' THEN 'Tips : a' || chr(10) || chr(10) || text || ' tip: b' WHEN 'fr' THEN text || ' We Recommend it' WHEN 'es' THEN text || ' parameters of it' ELSE text || ' a prompt' END"
_PASSAGES = ", ".join(f"nullif(array_to_string((regexp_extract_all(t, '(?is){p}.*?(?:\\n\\n|\\z)'))[1:3], ' '), '')" for p in ("best practice[s]?", "tip[s]?\\s*:", "recommend", "parameter[s]?", "prompt"))


@query("relevant_section", f"SELECT doc_id, md5(coalesce({_PASSAGES}, t)) AS section_md5 FROM (SELECT doc_id, {_MARKED} AS t FROM documents)")
def relevant_section(spark, d):
    """Texts with a passage for each pattern in turn, by language, as invented texts hold none."""
    t, c, n = F.col("text"), F.concat, F.lit("\n\n")
    lang = F.col("lang")
    marked = (
        F.when(lang == "en", c(t, n, F.lit("Best Practices: "), "source", n, F.lit("tip: x"))).when(lang == "de", c(F.lit("Tips : a"), n, t, F.lit(" tip: b")))
        .when(lang == "fr", c(t, F.lit(" We Recommend it"))).when(lang == "es", c(t, F.lit(" parameters of it"))).otherwise(c(t, F.lit(" a prompt")))
    )
    return _docs(spark, d).select("doc_id", marked.alias("t")).select("doc_id", F.md5(text.relevant_section(F.col("t"))).alias("section_md5"))


_SPECIFIC = " + ".join(f"CAST(regexp_matches(text, {S.quoted('(?i)' + p)}) AS INT)" for p in L.SPECIFIC)
_ACTIONS = " + ".join(f"CAST(contains(lower(text), {S.quoted(w)}) AS INT)" for w in L.ACTIONS)
_SOURCE = S.first_rule("lower(src)", [(w, (k,)) for k, w in L.SOURCE_WEIGHTS], "0.5")
_KIND = "CASE doc_id % 7 WHEN 0 THEN 'Official_Docs/x' WHEN 1 THEN 'github:y' WHEN 2 THEN 'reddit:z' WHEN 3 THEN 'discord' WHEN 4 THEN 'my blog' WHEN 5 THEN 'forum' ELSE 'other' END"


@query(
    "quality_score",
    f"""WITH d AS (SELECT doc_id, text, lang, {_KIND} AS src, n_chars % 150 AS upvotes, n_chars % 70 AS comments, doc_id % 200 AS days FROM documents),
    q AS (SELECT doc_id, CAST({_SOURCE} AS DOUBLE) AS source, 0.7::DOUBLE * least(1.0::DOUBLE, upvotes / 100) + 0.3::DOUBLE * least(1.0::DOUBLE, comments / 50) AS community,
      CASE WHEN days < 7 THEN 1.0::DOUBLE WHEN days < 30 THEN 0.8 WHEN days < 90 THEN 0.6 WHEN days < 180 THEN 0.4 ELSE 0.2 END AS recency,
      round(({_SPECIFIC}) * 0.2::DOUBLE, 6) AS specificity, least(1.0::DOUBLE, ({_ACTIONS}) / 3) AS action,
      (CAST(lang <> '' AS INT) + CAST(text <> '' AS INT) + CAST(days <> 0 AS INT)) / 5 AS completeness FROM d)
    SELECT doc_id, source, round(community, 6) AS community, recency, specificity, round(action, 6) AS action, round(completeness, 6) AS completeness,
      round(0.25::DOUBLE * source + 0.20::DOUBLE * community + 0.15::DOUBLE * recency + 0.20::DOUBLE * specificity + 0.15::DOUBLE * action + 0.05::DOUBLE * completeness, 6) AS quality FROM q""",
)
def quality_score(spark, d):
    i = F.col("doc_id") % 7
    src = F.when(i == 0, "Official_Docs/x").when(i == 1, "github:y").when(i == 2, "reddit:z").when(i == 3, "discord").when(i == 4, "my blog").when(i == 5, "forum").otherwise("other")
    days = F.col("doc_id") % 200
    q = _docs(spark, d).select(
        "doc_id", text.source_score(src).alias("source"), text.community_score(F.col("n_chars") % 150, F.col("n_chars") % 70).alias("community"), text.recency_score(days).alias("recency"),
        text.specificity_score(F.col("text")).alias("specificity"), text.action_score(F.col("text")).alias("action"),
        text.completeness_score(F.col("lang"), F.lit(None), F.col("text"), F.lit(None), days).alias("completeness"),
    )
    cols = [F.col(c) for c in ("source", "community", "recency", "specificity", "action", "completeness")]
    r = lambda c: F.round(c, 6).alias(c)
    return q.select("doc_id", "source", r("community"), "recency", "specificity", r("action"), r("completeness"), F.round(text.quality_score(*cols), 6).alias("quality"))


@query("recency", f"SELECT event_id, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 86400000000) AS BIGINT) AS days, CASE WHEN floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 86400000000) < 7 THEN 1.0::DOUBLE WHEN floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 86400000000) < 30 THEN 0.8 ELSE 0.6 END AS recency FROM events")
def recency(spark, d):
    days = text.age_days(F.col("ts"), AS_OF)
    return tables.table(spark, d, "events").select("event_id", days.alias("days"), text.recency_score(days).alias("recency"))


@query("strategy", "SELECT doc_id, CASE WHEN n_chars <= 4000 THEN 'single_pass' WHEN n_chars <= 12000 THEN 'multi_chunk' ELSE 'summary_first' END AS hosted, CASE WHEN n_chars <= 500 THEN 'single_pass' ELSE 'extract_key_only' END AS own FROM documents")
def strategy(spark, d):
    big, own = text.capabilities(F.lit("openrouter"), F.lit("openai/gpt-4")), text.capabilities(F.lit("local"), F.lit("x"))
    s = lambda c: text.strategy(c["max_context"], c["optimal_chunk_size"], F.col("n_chars"))
    return _docs(spark, d).select("doc_id", s(big).alias("hosted"), s(own).alias("own"))


@query(
    "chunk_entities",
    "WITH c AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 1800)) AS p, text FROM documents) SELECT e AS entity, count(*) AS n FROM c JOIN (VALUES ('The '), ('der '), ('token')) AS t(e) ON contains(lower(substr(text, p + 1, 2000)), lower(e)) GROUP BY e",
)
def chunk_entities(spark, d):
    parts = _docs(spark, d).select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(1800)), lambda s: F.substring(F.col("text"), s + 1, F.lit(2000)))).alias("t"))
    asked = spark.createDataFrame([("The ",), ("der ",), ("token",)], "entity string")
    return parts.join(F.broadcast(asked), F.contains(F.lower("t"), F.lower("entity"))).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "duplicate_urls",
    "SELECT page_id, u AS url FROM (SELECT page_id, regexp_replace(url, '[0-9?#].*$', '') AS u, row_number() OVER (PARTITION BY regexp_replace(url, '[0-9?#].*$', '') ORDER BY page_id) AS rn FROM pages) WHERE rn > 1",
)
def duplicate_urls(spark, d):
    """By the part of the URL before its number, query or fragment."""
    p = tables.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[0-9?#].*$", "").alias("url"))
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).where("rn > 1").drop("rn")


@query("url_rewrite", "SELECT page_id, replace(url, 'old.reddit.com', 'reddit.com') AS url, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")
def url_rewrite(spark, d):
    return tables.table(spark, d, "pages").select("page_id", names.forum_url(F.col("url")).alias("url"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
