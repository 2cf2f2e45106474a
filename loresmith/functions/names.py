"""Names: normal forms, slugs, categories and edit-distance similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loresmith.functions import lookups as L


def normalise(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    """Lower case, blanks to hyphens, letters, digits and hyphens of any script."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", "")


def clean(c: Column) -> Column:
    """Word characters, blanks, hyphens and dots; runs of blanks are one."""
    kept = F.regexp_replace(c, r"(?U)[^\w\s\-.]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def canonical(c: Column) -> Column:
    """Normal form without one trailing word such as ai, api, platform or .com."""
    bare = F.regexp_replace(F.lower(c), r"\s*(ai|api|platform|tool|app|\.ai|\.io|\.com)$", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def sanitise_model(c: Column) -> Column:
    """A model name fit for a path: no bracketed parts or reserved characters; null where it names a release or nothing."""
    bare = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*", ""))
    bare = F.when(~F.contains(F.lower(bare), F.lit("release")), F.trim(F.regexp_replace(bare, r'[<>:"/\\|?*]', "")))
    bare = F.when(F.lower(bare) == "llama", F.lit("llama-3")).otherwise(bare)
    return F.nullif(bare, F.lit(""))


def forum_url(c: Column) -> Column:
    return F.replace(c, F.lit("old.reddit.com"), F.lit("reddit.com"))


def model_alias(c: Column) -> Column:
    """The canonical spelling of a known alias, else the trimmed name."""
    known = F.create_map(*(F.lit(x) for pair in L.MODEL_ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.trim(F.lower(c))), F.trim(c))


def category(name: Column, description: Column) -> Column:
    """First category whose keywords the name, or the name and description, holds."""
    low, both = F.lower(name), F.lower(F.concat(name, F.lit(" "), description))
    out = F.lit("general")
    for label, names, words in reversed(L.CATEGORY_RULES):
        hit = L.holds(low, names) | L.holds(both, words)
        if label == "text":
            hit = hit & ~L.holds(both, L.NOT_TEXT)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def fallback_category(name: Column, known: Column) -> Column:
    """The registry's category, or where that is missing or general, one by the name's keywords."""
    given = F.coalesce(known, F.lit("general"))
    return F.when(given != "general", given).otherwise(L.first_rule(F.lower(name), L.FALLBACK_CATEGORIES, "general"))


def pattern_category(name: Column) -> Column:
    """Category by substring of a model name; text if none."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("text")).otherwise(L.first_rule(F.lower(name), L.PATTERN_CATEGORIES, "text"))


def is_service(name: Column, url: Column, description: Column) -> Column:
    """A listed entry is a service rather than an article or a list."""
    words = F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))
    low_url = F.lower(F.coalesce(url, F.lit("")))
    strong = L.holds(F.lower(F.concat(name, F.lit(" "), description)), L.STRONG_WORDS) & (words <= 2)
    return (
        F.when(words > 5, False).when(L.holds(F.lower(name), L.SKIP_WORDS), False).when(L.holds(F.lower(description), L.ARTICLE_PHRASES), False)
        .when(L.holds(low_url, L.ARTICLE_URLS), False).when(L.holds(low_url, L.SERVICE_URLS), True).otherwise(strong)
    )


def variations(name: Column) -> Column:
    """Spellings under which an entry is looked up: an array without repeats."""
    low = F.lower(name)
    cut = [F.regexp_replace(low, p, "") for p in ("-instruct$", "-chat$", "-gguf$", "-1m$", "-cli$")]
    base = F.regexp_extract(low, r"^[a-z]+\d*", 0)
    every = F.array(
        F.regexp_replace(low, r"-[\d.]+[a-z]*$", ""), F.when(base != "", base), F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("_"), F.lit("-")),
        F.regexp_replace(low, "[-_]", " "), *cut, F.regexp_replace(low, "^gemini-", "gemini"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def similarity(a: Column, b: Column) -> Column:
    """Of normal forms: 1 if equal, 0.8 if one holds the other, else one less the edit distance by the longer length."""
    x, y = normalise(a), normalise(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(0.8)).otherwise(1 - F.levenshtein(x, y) / longest)


def context_length(name: Column) -> Column:
    """Default context length by a model name's pattern."""
    return L.first_rule(F.lower(name), ((n, words) for words, n in L.CONTEXT_DEFAULTS), 8192)


def search_query(service: Column, pattern: Column) -> Column:
    return F.replace(pattern, F.lit("{service}"), service)


def search_url(query: Column) -> Column:
    return F.concat(F.lit(L.SEARCH_BASE), F.replace(F.replace(query, F.lit(" "), F.lit("+")), F.lit('"'), F.lit("%22")))


def setting_text(entries: Column) -> Column:
    """'key = value' of each entry of a map."""
    return F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))


def source_kind(source: Column) -> Column:
    """The kind of source that a name asks for: reddit or github; null for any other."""
    return F.when(source.startswith("reddit:"), "reddit").when(source.startswith("github:"), "github")


def source_icon(source: Column) -> Column:
    return F.when(source.startswith("reddit:"), "forum").when(source.startswith("github:"), "code").when(source.startswith("hackernews:"), "news").otherwise("web")


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
