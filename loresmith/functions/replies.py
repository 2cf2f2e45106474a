"""What a model's reply says, as column expressions: cleaned text, practices, entities, judgements.

A reply is text that should be JSON. What cannot be read gives a defined row (a fallback practice, an
entity of low relevance, a rejecting judgement), never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: what replies begin and end with, and words by which plain text still counts as a practice
PREFIXES = ("Here is the JSON:", "Here's the JSON:", "JSON:", "```json", "```", "The JSON response is:", "Here is the extracted JSON:", "Based on the analysis, here is the JSON:")
SUFFIXES = ("```", "\n\nI hope this helps!", "\n\nLet me know if")
PRACTICE_PREFIXES = ("Here is the JSON:", "Here's the JSON:", "JSON:", "Based on the analysis:")
FALLBACK_WORDS = ("tip", "practice", "recommend", "use", "avoid", "setting", "parameter")
#: Where JSON stands in a text: in a fence, with one level within it, between the outermost brackets (fixed values).
ANY_JSON = (r"(?s)```(?:json)?\s*([\[{].*?[\]}])\s*```", r"(?s)([\[{][^\[{]*(?:[\[{][^\[{\]}]*[\]}][^\[{\]}]*)*[\]}])", r"(?s)([\[{].*[\]}])")
OBJECTS = (r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})", r"(?s)(\{.*?\})")

PRACTICE = "struct<practice_type:string,content:string,model_name:string,confidence:double,source:string,category:string>"
ENTITIES = "struct<models_mentioned:array<string>,theme:string,techniques:array<string>,parameters:map<string,string>,is_ai_related:boolean,relevance_score:double,summary:string>"
ITEM = "struct<practice_type:string,content:string,details:string,benefit:string,problem:string,solution:string,savings:string,applicable_models:array<string>,confidence:double>"
JUDGED = "struct<is_relevant:boolean,is_specific:boolean,is_actionable:boolean,quality_score:double,reason:string,improved_content:string>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _without(c: Column, prefixes: tuple[str, ...]) -> Column:
    """Without each prefix in turn, whatever its case."""
    for p in prefixes:
        c = strip(F.regexp_replace(c, "(?i)^" + re.escape(p).replace("\\ ", " "), ""))
    return c


def clean(c: Column) -> Column:
    """A reply without the words that models put around JSON; text without brackets stays."""
    c = _without(strip(c), PREFIXES)
    for s in SUFFIXES:
        c = strip(F.substring_index(c, s, 1))
    inner = F.regexp_extract(c, r"(?s)[\[{].*[\]}]", 0)
    return F.when((c == "") | c.rlike(r"^[\[{]") | (inner == ""), c).otherwise(inner)


def _readable(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull() & (strip(c) != "")


def _first_readable(c: Column, patterns: tuple[str, ...], *, empty: bool = True) -> Column:
    """The first match of the first pattern that is JSON. empty: an empty list or object counts too."""
    fits = lambda m: _readable(m) if empty else _readable(m) & ~m.rlike(r"^[\[{]\s*[\]}]$")
    return F.coalesce(*(F.get(F.filter(F.regexp_extract_all(c, F.lit(p), F.lit(1)), fits), 0) for p in patterns))


def practice_json(c: Column) -> Column:
    """The JSON that a reply holds, by its whole text, else by what stands in it; null without any."""
    return F.when(_readable(c), c).otherwise(_first_readable(_without(strip(c), PRACTICE_PREFIXES), ANY_JSON, empty=False))


def practices(c: Column, source: Column) -> Column:
    """array<PRACTICE> of a reply: a list, or an object's list; rows without all required fields are left out.

    A reply without JSON that holds a word of advice is one tip of confidence 0.3, by its first 200 characters.
    """
    j = practice_json(c)
    listed = F.when(strip(j).startswith("["), F.from_json(j, f"array<{PRACTICE}>")).when(strip(j).startswith("{"), F.from_json(j, f"practices array<{PRACTICE}>")["practices"])
    given = lambda p: p["practice_type"].isNotNull() & p["content"].isNotNull() & p["model_name"].isNotNull() & p["confidence"].isNotNull() & p["source"].isNotNull()
    kept = F.transform(F.filter(listed, given), lambda p: p.withField("category", F.coalesce(p["category"], F.lit("general"))))
    text = F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c)
    tip = F.struct(F.lit("tip").alias("practice_type"), text.alias("content"), F.lit("general").alias("model_name"), F.lit(0.3).alias("confidence"), source.alias("source"), F.lit("general").alias("category"))
    advice = F.lower(c).rlike("|".join(FALLBACK_WORDS))
    none = F.array().cast(f"array<{PRACTICE}>")
    return F.when(j.isNull() & advice, F.array(tip)).when(j.isNull(), none).otherwise(F.coalesce(kept, none))


def entities(c: Column) -> Column:
    """ENTITIES of a reply; one without JSON may still be of interest, at relevance 0.3."""
    j = F.when(_readable(c), c).otherwise(_first_readable(c, OBJECTS))
    e = F.from_json(j, ENTITIES)
    none = F.array().cast("array<string>")
    found = F.struct(
        F.coalesce(e["models_mentioned"], none).alias("models_mentioned"), F.coalesce(e["theme"], F.lit("general")).alias("theme"), F.coalesce(e["techniques"], none).alias("techniques"),
        F.coalesce(e["parameters"], F.create_map().cast("map<string,string>")).alias("parameters"), F.coalesce(e["is_ai_related"], F.lit(False)).alias("is_ai_related"),
        F.coalesce(e["relevance_score"], F.lit(0.0)).alias("relevance_score"), F.coalesce(e["summary"], F.lit("")).alias("summary"),
    )
    unread = F.struct(
        none.alias("models_mentioned"), F.lit("general").alias("theme"), none.alias("techniques"), F.create_map().cast("map<string,string>").alias("parameters"), F.lit(True).alias("is_ai_related"),
        F.lit(0.3).alias("relevance_score"), F.lit("Could not parse LLM response").alias("summary"),
    )
    return F.when(j.isNull(), unread).otherwise(found)


def items(c: Column, models: Column) -> Column:
    """array<ITEM> of a reply, by three shapes: a tip; a problem with its solution; anything else with a content.

    models: those that the text mentions; the first of them stands in where an item names none, else "general".
    """
    raw = "array<struct<tip:string,model_or_service:string,details:string,type:string,benefit:string,problem:string,solution:string,practice_type:string,service_name:string,savings_or_improvement:string,content:string,confidence:double>>"
    inner = F.regexp_extract(c, r"(?s)\[.*?\]", 0)
    is_list = lambda t: _readable(t) & strip(t).startswith("[")
    found = F.from_json(F.when(is_list(c), c).when(~_readable(c) & is_list(inner), inner).otherwise(F.lit("[]")), raw)
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    own = F.when(F.size(models) > 0, F.slice(models, 1, 1)).otherwise(F.array(F.lit("general")))
    null = F.lit(None).cast("string")

    def item(kind, content, details=null, benefit=null, problem=null, solution=null, savings=null, to=own, confidence=None):
        names = ("practice_type", "content", "details", "benefit", "problem", "solution", "savings", "applicable_models", "confidence")
        return F.struct(*(v.alias(n) for n, v in zip(names, (kind, content, details, benefit, problem, solution, savings, to, confidence), strict=True)))

    def shaped(x):
        named = F.coalesce(x["model_or_service"], F.lit("unknown"))
        sure = F.coalesce(x["confidence"], F.lit(0.5))
        tip = item(
            F.coalesce(x["type"], F.lit("technique")), x["tip"], F.coalesce(x["details"], F.lit("")), F.coalesce(x["benefit"], F.lit("")),
            to=F.when(named != "unknown", F.array(named)).otherwise(own), confidence=F.lit(0.7),
        )
        solved = item(
            F.coalesce(x["practice_type"], F.lit("cost_optimization")), F.concat(F.lit("Problem: "), x["problem"], F.lit("\nSolution: "), x["solution"]), problem=x["problem"], solution=x["solution"],
            savings=x["savings_or_improvement"], to=F.when(some(x["service_name"]), F.array(x["service_name"])).otherwise(own), confidence=sure,
        )
        other = item(F.lit("tip"), F.coalesce(x["content"], F.to_json(x)), confidence=sure)
        return F.when(some(x["tip"]), tip).when(some(x["problem"]) & some(x["solution"]), solved).otherwise(other)

    return F.coalesce(F.transform(found, shaped), F.array().cast(f"array<{ITEM}>"))


def judgement(c: Column) -> Column:
    """JUDGED of a reply; what cannot be read rejects."""
    j = F.when(_readable(c), c).otherwise(_first_readable(c, (OBJECTS[0], r"(?s)(\{.*\})")))
    e = F.from_json(j, JUDGED)
    no = lambda k: F.coalesce(e[k], F.lit(False)).alias(k)
    reason = F.when(j.isNull(), F.lit("Failed to parse evaluation")).otherwise(F.coalesce(e["reason"], F.lit("")))
    return F.struct(no("is_relevant"), no("is_specific"), no("is_actionable"), F.coalesce(e["quality_score"], F.lit(0.0)).alias("quality_score"), reason.alias("reason"), e["improved_content"].alias("improved_content"))
