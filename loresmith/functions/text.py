"""Texts: token budgets, chunks, headers, JSON in replies, and quality scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loresmith.functions import lookups as L

TRUNCATED = "\n\n[Content truncated...]"


def token_count(c: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(c) / 4).cast("long")


def usable_tokens(limit: Column, reserved: int, least: int) -> Column:
    """Tokens for content: what the reserve leaves, at least ``least`` where that is under 1000."""
    left = limit - reserved
    return F.when(left < 1000, F.greatest(F.lit(least), left)).otherwise(left)


def truncate_tokens(c: Column, tokens: int) -> Column:
    """The longest prefix within the tokens, marked as cut."""
    return F.when(token_count(c) <= tokens, c).otherwise(F.concat(F.substring(c, 1, 4 * tokens + 3), F.lit(TRUNCATED)))


def headers(c: Column) -> Column:
    """First five markdown headers."""
    return F.slice(F.regexp_extract_all(c, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1)), 1, 5)


def chunk_id(start: Column, end: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", start.cast("string"), end.cast("string"))), 1, 8)


def overlap_chunks(c: Column, size: int = 8000, overlap: int = 500, least: int = 1000) -> Column:
    """Array of structs of chunks of ``size`` characters, ``overlap`` shared with the next.

    A short text is one chunk without headers. A last chunk under ``least`` joins the one before,
    whose headers and overlap stay as they were.
    """
    assert least <= size and overlap < size
    n, step = F.length(c), size - overlap
    one = F.array(_chunk(c, F.lit(0), n, F.lit(0), F.lit(1), F.lit(0), F.lit(0), F.array().cast("array<string>")))
    total = (F.floor((n - size) / step) + 1 + F.when((n - size) % step > 0, 1).otherwise(0)).cast("int")
    last = F.floor((n - 1) / step).cast("int")  # the last start before the end
    short = F.greatest(F.lit(1), (F.floor((n - least) / step) + 1).cast("int"))  # the first start too near to it
    kept = F.least(short, last + 1)

    def at(i: Column) -> Column:
        s = i * step
        own_end = F.least(s + size, n)
        end = F.when((i == kept - 1) & (short <= last), F.least(short * step + size, n)).otherwise(own_end)
        return _chunk(F.substring(c, s + 1, end - s), s, end, i, total, F.when(i > 0, overlap).otherwise(0), F.when(own_end < n, overlap).otherwise(0), headers(F.substring(c, s + 1, own_end - s)))

    return F.when(n <= size, one).otherwise(F.transform(F.sequence(F.lit(0), kept - 1), at))


def _chunk(text, start, end, index, total, before, after, heads) -> Column:
    return F.struct(
        text.alias("text"), start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), index.cast("int").alias("chunk_index"), total.cast("int").alias("total_chunks"),
        before.cast("int").alias("overlap_with_previous"), after.cast("int").alias("overlap_with_next"), heads.alias("section_headers"),
    )


def relevant_section(c: Column) -> Column:
    """Up to three passages of the first pattern that the text holds, else the text."""
    patterns = (r"best practice[s]?.*?(?:\n\n|\z)", r"tip[s]?\s*:.*?(?:\n\n|\z)", r"recommend.*?(?:\n\n|\z)", r"parameter[s]?.*?(?:\n\n|\z)", r"prompt.*?(?:\n\n|\z)")
    found = [F.regexp_extract_all(c, F.lit("(?is)" + p), F.lit(0)) for p in patterns]
    return F.coalesce(*(F.when(F.size(f) > 0, F.array_join(F.slice(f, 1, 3), " ")) for f in found), c)


def strategy(max_context: Column, optimal: Column, size: Column) -> Column:
    """How a text of that size is processed by a model of that capability."""
    fits = size <= optimal
    return (
        F.when(max_context > 100000, F.when(size <= 50000, "single_pass").otherwise("multi_chunk"))
        .when(max_context > 8000, F.when(fits, "single_pass").when(size <= optimal * 3, "multi_chunk").otherwise("summary_first"))
        .otherwise(F.when(fits, "single_pass").otherwise("extract_key_only"))
    )


def capabilities(provider: Column, model: Column) -> Column:
    """(max_context, supports_json_mode, optimal_chunk_size) of a model."""
    low = F.lower(model)
    is_ = lambda *words: L.holds(low, words)
    make = lambda context, json, chunk: F.struct(F.lit(context).alias("max_context"), F.lit(json).alias("supports_json_mode"), F.lit(chunk).alias("optimal_chunk_size"))
    hosted = (
        F.when(is_("claude"), F.when(is_("3-opus", "3.5"), make(200000, True, 50000)).otherwise(make(100000, True, 25000)))
        .when(is_("gpt-4"), F.when(is_("turbo", "128k"), make(128000, True, 32000)).otherwise(make(8192, True, 4000)))
        .when(is_("gemini"), F.when(is_("1.5"), make(1000000, True, 100000)).otherwise(make(32000, True, 8000)))
        .otherwise(make(32000, True, 8000))
    )
    return F.when(provider == "local", make(2048, False, 500)).when(provider == "openrouter", hosted).otherwise(make(4096, False, 2000))


def json_object(c: Column) -> Column:
    """The JSON of a reply: the reply itself, a fenced block, or its outermost or innermost braces; else null."""
    tries = (c, F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(c, r"(?s)\{.*\}", 0), F.regexp_extract(c, r"\{[^{}]*\}", 0))
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull() & (F.trim(t) != ""), t) for t in tries))


def json_array(c: Column) -> Column:
    """The JSON array of a reply, or an empty one."""
    inner = F.regexp_extract(c, r"(?s)\[.*?\]", 0)
    is_array = lambda t: F.try_parse_json(t).isNotNull() & F.trim(t).startswith("[")
    return F.coalesce(F.when(is_array(c), c), F.when(is_array(inner), inner), F.lit("[]"))


# --- quality of a practice


def source_score(source: Column) -> Column:
    return L.first_rule(F.lower(source), ((w, (k,)) for k, w in L.SOURCE_WEIGHTS), 0.5)


def community_score(upvotes: Column, comments: Column) -> Column:
    return 0.7 * F.least(F.lit(1.0), upvotes / 100) + 0.3 * F.least(F.lit(1.0), comments / 50)


def age_days(ts: Column, as_of: str) -> Column:
    """Whole days of 86,400 seconds between a time and a given moment."""
    gap = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.floor(gap / F.lit(86_400_000_000)).cast("long")


def recency_score(days: Column) -> Column:
    return F.when(days.isNull(), 0.5).when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.6).when(days < 180, 0.4).otherwise(0.2)


def specificity_score(content: Column) -> Column:
    hits = sum((content.rlike("(?i)" + p).cast("int") for p in L.SPECIFIC[1:]), content.rlike("(?i)" + L.SPECIFIC[0]).cast("int"))
    return F.round(hits * 0.2, 6)


def action_score(content: Column) -> Column:
    low = F.lower(content)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in L.ACTIONS[1:]), F.contains(low, F.lit(L.ACTIONS[0])).cast("int"))
    return F.least(F.lit(1.0), hits / 3)


def completeness_score(*fields: Column) -> Column:
    """Share of fields that hold something; a zero confidence does not count."""
    has = [F.coalesce((f.cast("string") != "") & (f.cast("string") != "0") & (f.cast("string") != "0.0"), F.lit(False)).cast("int") for f in fields]
    return sum(has[1:], has[0]) / len(fields)


def quality_score(source, community, recency, specificity, action, completeness) -> Column:
    return 0.25 * source + 0.20 * community + 0.15 * recency + 0.20 * specificity + 0.15 * action + 0.05 * completeness


def age_days_between(start: Column, end: Column) -> Column:
    """Whole days of 86,400 seconds from one time to another."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
