"""Extraction in stages: entities, practices, judgement, and the passes over long texts.

Only ``ask`` leaves the JVM: it sends a prompt column to an extractor, made once a task, and adds its
replies. Prompts, parsing, merging and scores are column expressions around it. Replies are not
deterministic, so a stage's result must be written before it is used twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresmith.functions import replies, text
from loresmith.operators import merge, pack
from loresmith.operators.extract import Extractor

#: Characters of a text that prompts for entities, for practices and for a judgement show (fixed values).
ENTITY_HEAD, PRACTICE_HEAD, CONTEXT_HEAD = 2000, 3000, 500
#: Relevance from which practices are asked for, and by source from which posts are kept (fixed values).
GATE = 0.3
SOURCE_GATES = (("news", 0.4), ("readme", 0.3))
BATCH = 64


def ask(df: DataFrame, prompt: str, make: Callable[[], Extractor], *, out: str = "reply", cleaned: bool = True) -> DataFrame:
    """``df`` with the extractor's reply to each row's prompt; "{}" where it fails, null where there is no prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = None
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part, got = b.slice(at, BATCH), []
                for p in part.column(prompt).to_pylist():
                    if p is None:
                        got.append(None)
                        continue
                    extractor = extractor or make()
                    try:
                        got.append(extractor(p))
                    except PermissionError:  # a wrong credential will not mend
                        raise
                    except Exception:
                        got.append("{}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"
    asked = df.mapInArrow(run, schema)
    return asked.withColumn(out, replies.clean(F.col(out))) if cleaned else asked


def prompt(kind: str, about: Column, body: Column) -> Column:
    """What an extractor is asked: a line with the kind, one with what it is about, and the text."""
    return F.concat(F.lit(f"Task: {kind}\nAbout: "), about, F.lit("\nAnswer with JSON only.\nText:\n"), body)


def entities(docs: DataFrame, content: str, source: str, make: Callable[[], Extractor]) -> DataFrame:
    """``docs`` with the fields of the entities that their heads name (models_mentioned, theme, ...)."""
    p = docs.withColumn("_prompt", prompt("entities", F.col(source), F.substring(content, 1, ENTITY_HEAD)))
    found = ask(p, "_prompt", make, out="_reply", cleaned=False).withColumn("_e", replies.entities(F.col("_reply")))
    return found.select(*docs.columns, "_e.*")


def relevant(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with entities that a kind of source keeps: forums what is related at all, others what is relevant enough."""
    gates = dict(SOURCE_GATES)
    return rows.where("is_ai_related") if kind not in gates else rows.where(F.col("relevance_score") > gates[kind])


def practices(rows: DataFrame, content: str, make: Callable[[], Extractor]) -> DataFrame:
    """``rows`` (with entities) and an array of practices; rows that are not relevant enough are not asked about."""
    about = F.concat_ws("; ", F.when(F.size("models_mentioned") > 0, F.array_join("models_mentioned", ", ")), F.col("theme"))
    gate = F.col("is_ai_related") & (F.col("relevance_score") >= GATE)
    p = rows.withColumn("_prompt", F.when(gate, prompt("practices", about, F.substring(content, 1, PRACTICE_HEAD))))
    asked = ask(p, "_prompt", make, out="_reply")
    found = F.when(F.col("_reply").isNotNull(), replies.items(F.col("_reply"), F.col("models_mentioned"))).otherwise(F.array().cast(f"array<{replies.ITEM}>"))
    return asked.select(*rows.columns, found.alias("practices"))


def judge(rows: DataFrame, model: str, context: str, make: Callable[[], Extractor]) -> DataFrame:
    """``rows`` (content, practice_type, applicable_models, ...) judged for a model.

    Adds quality_score and judgement; content is the improved one where the judge gives any.
    """
    claim = F.concat_ws(" | ", F.col("practice_type"), F.col("content"), F.array_join("applicable_models", ", "))
    p = rows.withColumn("_prompt", prompt("judge", F.concat_ws(": ", F.col(model), claim), F.substring(context, 1, CONTEXT_HEAD)))
    asked = ask(p, "_prompt", make, out="_reply").withColumn("judgement", replies.judgement(F.col("_reply")))
    better = F.coalesce(F.when(F.col("judgement.improved_content") != "", F.col("judgement.improved_content")), F.col("content"))
    return asked.select(*(better.alias(c) if c == "content" else F.col(c) for c in rows.columns), F.col("judgement.quality_score").alias("quality_score"), "judgement")


def content_practices(docs: DataFrame, content: str, source: str, make: Callable[[], Extractor], *, size: int = 8000, overlap: int = 500, least: int = 1000) -> DataFrame:
    """One row a practice of each overlapping chunk of ``docs``: (columns, chunk_index, practice fields)."""
    chunk = docs.select(*docs.columns, F.explode(text.overlap_chunks(F.col(content), size, overlap, least)).alias("_c"))
    p = chunk.withColumn("_prompt", prompt("content", F.col(source), F.col("_c.text"))).withColumn("chunk_index", F.col("_c.chunk_index")).drop("_c")
    asked = ask(p, "_prompt", make, out="_reply", cleaned=False)
    return asked.select(*docs.columns, "chunk_index", F.explode(replies.practices(F.col("_reply"), F.col(source))).alias("_p")).select(*docs.columns, "chunk_index", "_p.*")


def enhance(posts: DataFrame, order: list[Column], make: Callable[[], Extractor], *, top: int = 5) -> DataFrame:
    """Practices of the top posts (post_id, title, content, source): title and content together, chunk by chunk."""
    first = posts.orderBy(*order).limit(top)
    whole = first.select("post_id", "source", F.concat(F.lit("Title: "), "title", F.lit("\n\nContent: "), "content").alias("_text"))
    return content_practices(whole, "_text", "source", make).drop("_text")


CHUNK_ENTITIES = "models array<string>, services array<string>, techniques array<string>, parameters map<string,string>, tools array<string>, platforms array<string>"


def hierarchical(docs: DataFrame, make: Callable[[], Extractor], keep: Callable[[DataFrame], DataFrame], *, size: int = 8000, overlap: int = 500, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Three passes over ``docs`` (doc_id, text, source): entities of each chunk, practices of each entity in the
    chunks that mention it, and each document's distinct practices.

    keep: writes a stage's rows and gives the written table, as replies must not be asked for twice.
    Returns (doc_id, entity, type, content, confidence, example) of the practices, and of each document's
    entities (doc_id, entity, confidence): the mean of its practices, null without any; the entity "overall" is one
    for ten practices, less for fewer.
    """
    parts = pack.chunks(docs, "boundaries", size=size, overlap=overlap, least=least).join(docs.select("doc_id", "source"), "doc_id")
    place = F.concat(F.col("source"), F.lit(" "), F.col("chunk_index") + 1, F.lit("/"), F.col("total_chunks"))
    asked = ask(parts.withColumn("_prompt", prompt("chunk entities", place, F.col("text"))), "_prompt", make, out="_reply")
    told = keep(asked.select("doc_id", "chunk_index", "text", "source", F.from_json("_reply", CHUNK_ENTITIES).alias("_e")).select("doc_id", "chunk_index", "text", "source", "_e.*"))
    named = merge.entity_union(told, "doc_id").where("entity is not null")
    meet = told.select("doc_id", "chunk_index", "text", "source").join(named, "doc_id").where(F.contains(F.lower("text"), F.lower("entity")))
    asked = ask(meet.withColumn("_prompt", prompt("entity practices", F.concat_ws(" ", "source", "entity"), F.col("text"))), "_prompt", make, out="_reply")
    shape = "array<struct<entity:string,type:string,content:string,confidence:double,example:string>>"
    each = keep(asked.select("doc_id", F.col("entity").alias("_asked"), "chunk_index", F.posexplode(F.from_json("_reply", shape)).alias("pos", "p")).select("doc_id", "_asked", "chunk_index", "pos", "p.*"))
    # the same words in a document are one practice, the first by entity, chunk and place
    own = [c for c in ("entity", "type", "confidence", "example")]
    place = F.struct("_asked", "chunk_index", "pos")
    found = each.groupBy("doc_id", F.coalesce("content", F.lit("")).alias("content")).agg(*(F.min_by(c, place).alias(c) for c in own))
    found = found.select("doc_id", "entity", "type", "content", "confidence", "example")
    by = found.groupBy("doc_id", F.coalesce("entity", F.lit("unknown")).alias("entity")).agg(F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    overall = docs.select("doc_id").join(found.groupBy("doc_id").agg((F.count(F.lit(1)) / 10).alias("n")), "doc_id", "left").select("doc_id", F.lit("overall").alias("entity"), F.least(F.lit(1.0), F.coalesce("n", F.lit(0.0))).alias("confidence"))
    return found, named.join(by, ["doc_id", "entity"], "full_outer").unionByName(overall)


SERVICE = "struct<name:string,type:string,practices:array<struct<type:string,content:string,confidence:double,example:string>>>"
WHOLE = f"services array<{SERVICE}>, general_insights array<string>, quality_score double"


def adaptive(docs: DataFrame, provider: str, model: str, make: Callable[[], Extractor], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` (doc_id, text, source) processed as their size and the model's capability ask for.

    (doc_id, strategy, services, insights, overall_score, extraction_confidence, service_count,
    practice_count, error): in one pass, by sentence chunks whose results are merged, from a summary, or from
    the most relevant section alone. keep: see ``hierarchical``.
    """
    able = text.capabilities(F.lit(provider), F.lit(model))
    d = docs.withColumn("_able", able).withColumn("strategy", text.strategy(F.col("_able.max_context"), F.col("_able.optimal_chunk_size"), F.length("text")))
    size = docs.sparkSession.range(1).select(able["optimal_chunk_size"]).first()[0]
    head = lambda n: F.substring("text", 1, n)
    none = F.array().cast(f"array<{SERVICE}>")
    whole = d.where("strategy = 'single_pass'").select("doc_id", "strategy", F.lit(0).alias("chunk"), prompt("whole text", F.col("source"), head(size)).alias("_prompt"))
    chunked = d.where("strategy = 'multi_chunk'")
    parts = pack.chunks(chunked, "sentences", size=size).join(chunked.select("doc_id", "source"), "doc_id")
    place = F.concat(F.col("source"), F.lit(" "), F.col("chunk_index") + 1, F.lit("/"), F.col("total_chunks"))
    parts = parts.select("doc_id", F.lit("multi_chunk").alias("strategy"), F.col("chunk_index").alias("chunk"), prompt("part of a text", place, F.col("text")).alias("_prompt"))
    summed = d.where("strategy = 'summary_first'").select("doc_id", "strategy", F.lit(0).alias("chunk"), "source", prompt("summary", F.col("source"), head(size // 2)).alias("_prompt"))
    summed = ask(summed, "_prompt", make, out="_summary").select("doc_id", "strategy", "chunk", prompt("summarised text", F.col("source"), F.col("_summary")).alias("_prompt"))
    key = d.where("strategy = 'extract_key_only'").select("doc_id", "strategy", F.lit(0).alias("chunk"), prompt("key points", F.col("source"), F.substring(text.relevant_section(F.col("text")), 1, size)).alias("_prompt"))
    asked = keep(ask(whole.unionByName(parts).unionByName(summed).unionByName(key), "_prompt", make, out="_reply").drop("_prompt"))
    read = F.try_parse_json("_reply").isNotNull() & F.trim("_reply").startswith("{")
    short = F.from_json("_reply", "services array<string>, tips array<string>")
    empty = F.array().cast("array<struct<type:string,content:string,confidence:double,example:string>>")
    simple = F.transform(F.coalesce(short["services"], F.array().cast("array<string>")), lambda s: F.struct(s.alias("name"), F.lit("unknown").alias("type"), empty.alias("practices")))
    r = asked.select("doc_id", "strategy", "chunk", read.alias("read"), F.from_json("_reply", WHOLE).alias("w"), simple.alias("simple"), F.get_json_object("_reply", "$.quality_score").isNotNull().alias("scored"))
    services = r.where("read").select("doc_id", "strategy", F.posexplode(F.when(F.col("strategy") == "extract_key_only", F.col("simple")).otherwise(F.coalesce("w.services", none))).alias("pos", "s"), "chunk")
    order = F.struct("chunk", "pos")
    merged = services.groupBy("doc_id", F.coalesce("s.name", F.lit("unknown")).alias("name")).agg(
        F.min_by(F.coalesce("s.type", F.lit("unknown")), order).alias("type"), F.min(order).alias("at"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pos", F.coalesce("s.practices", empty).alias("p")))), lambda x: x["p"])).alias("practices"),
    )
    listed = merged.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "type", "practices"))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["practices"].alias("practices"))).alias("services"),
        F.count(F.lit(1)).alias("service_count"), F.sum(F.size("practices")).alias("practice_count"),
    )
    insights = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.coalesce("w.general_insights", F.array().cast("array<string>")).alias("i")))), lambda x: x["i"]))
    # without a score of its own, a merged text counts 0.5 and any other 0
    per = r.groupBy("doc_id", "strategy").agg(
        insights.alias("insights"), F.avg(F.when(F.col("scored"), F.col("w.quality_score"))).alias("_q"), F.max("read").alias("_read")
    )
    out = per.join(listed, "doc_id", "left").withColumns({"service_count": F.coalesce("service_count", F.lit(0)), "practice_count": F.coalesce("practice_count", F.lit(0))})
    multi = F.col("strategy") == "multi_chunk"
    return out.select(
        "doc_id", "strategy", F.coalesce("services", none).alias("services"), "insights", F.coalesce("_q", F.when(multi, 0.5).otherwise(0.0)).alias("overall_score"),
        merge.extraction_confidence(F.col("service_count"), F.col("practice_count")).alias("extraction_confidence"), "service_count", "practice_count",
        F.when(~F.col("_read") & ~multi, "extraction_failed").alias("error"),
    )


class KeywordExtractor:
    """Replies by plain rules, offline: names that the text holds are its models, services and entities.

    For tests and queries: what it says of a text can be told by SQL as well.
    """

    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def __call__(self, prompt: str) -> str:
        import json

        kind, about, body = prompt.split("\n", 1)[0].removeprefix("Task: "), prompt.split("\n", 2)[1].removeprefix("About: "), prompt.split("\nText:\n", 1)[1]
        found = [n for n in self.names if n in body]
        if kind == "entities":
            reply = {"models_mentioned": found, "theme": "tools" if found else "general", "is_ai_related": bool(found), "relevance_score": round(min(1.0, len(found) / 4), 2), "summary": body[:20]}
            return "So:\n```json\n" + json.dumps(reply) + "\n```" if len(found) % 2 else json.dumps(reply)
        if kind == "practices":
            return "Here is the JSON: " + json.dumps([{"tip": f"use {n}", "model_or_service": n, "type": "technique"} for n in found] + [{"problem": "slow", "solution": "wait"}])
        if kind == "judge":
            return json.dumps({"is_relevant": bool(found), "quality_score": round(len(found) / 8, 3), "reason": "words", "improved_content": "better" if len(found) > 2 else None})
        if kind == "content":
            practice = {"practice_type": "tip", "content": f"{len(found)} names", "model_name": found[0] if found else None, "confidence": 0.5, "source": about}
            return json.dumps({"practices": [practice]}) if found else "nothing to tell" if len(body) % 2 else "a setting"
        if kind == "chunk entities":
            return json.dumps({"models": found[:1], "services": found[1:2], "techniques": ["none"], "tools": found[2:3], "platforms": found[3:]})
        if kind == "entity practices":
            entity = about.rsplit(" ", 1)[-1]
            return json.dumps([{"entity": entity, "type": "tip", "content": f"about {entity}", "confidence": 0.8}, {"entity": entity, "type": "tip", "content": "shared", "confidence": 0.4}])
        if kind == "summary":
            return body[:100]
        if kind == "key points":
            return json.dumps({"models": found, "services": found[:3], "tips": ["x"]})
        return json.dumps({"services": [{"name": n, "type": "llm", "practices": [{"type": "tip", "content": "c", "confidence": 0.5}]} for n in found[:2]], "general_insights": found[2:], "quality_score": 0.25 * len(found)})
