"""Greedy packing of posts into prompts of a token budget, in order, and sentence chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loresmith.functions import text
from loresmith.operators import ordered
from loresmith.sources import shared

MARGIN = 200


def tokens(text: str) -> int:
    return len(text) // 4


def sentence_parts(content: str, room: int) -> list[str]:
    """A post over the budget as parts of whole sentences, of at most ``room`` tokens each; a longer sentence is a part of its own."""
    out, part, used = [], [], 0
    for sentence in content.split(". ") if content else []:
        n = tokens(sentence + ". ")
        if used + n > room:
            if part:
                out.append(". ".join(part) + ".")
            part, used = [sentence], n
        else:
            part.append(sentence)
            used += n
    if part:
        text = ". ".join(part)
        out.append(text if text.endswith(".") else text + ".")
    return out


def pack_posts(posts: Iterable[dict], usable: int, base: int) -> Iterator[list[dict]]:
    """Batches of posts (cost, content, ...) in order; a post over the budget becomes batches of its sentences."""
    batch, held = [], 0
    for post in posts:
        if base + held + post["cost"] <= usable:
            batch.append(post)
            held += post["cost"]
            continue
        if batch:
            yield batch
        batch, held = [post], post["cost"]
        if post["cost"] <= usable - base:
            continue
        batch, held = [], 0
        for part in sentence_parts(post["content"], usable - base - MARGIN):
            yield [post | {"content": part}]
    if batch:
        yield batch


#: Posts of a key from which its fold is not one task's sequence.
HOT = 1_000_000
PACKED = "k string, batch int, post_id long, content string"


def pack_batches(posts: DataFrame, *, key: str, order: str, usable: int, base: int) -> DataFrame:
    """(key, batch, post_id, content, n_chars): posts (post_id, content, cost) packed in order, each key for itself.

    content: what the batch holds of the post, for a divided one its part. Null contents are empty, and null keys a key of their own.
    Packing is a fold with a reset. Keys of up to ``HOT`` posts stream by in order, and only the open batch is held; a key of more
    goes by ``fold_by_pointers``.
    """
    p = posts.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col("post_id").cast("long"), F.coalesce("content", F.lit("")).alias("content"), F.col("cost").cast("long"))
    crowded = p.groupBy("k").count().where(F.col("count") > HOT).select(F.col("k").alias("_k"))
    keys = [r[0] for r in crowded.limit(MANY + 1).collect()]
    if len(keys) > MANY:  # all keys then: rounds are the same for one and for all
        out = fold_by_pointers(p, usable, base)
    elif keys:
        hot = F.coalesce(F.col("k").isin([k for k in keys if k is not None]), F.lit(None in keys))
        out = fold_in_tasks(p.where(~hot), usable, base).unionByName(fold_by_pointers(p.where(hot), usable, base))
    else:
        out = fold_in_tasks(p, usable, base)
    return out.select(F.col("k").alias(key), "batch", "post_id", "content", F.length("content").cast("long").alias("n_chars"))


def asked(posts: DataFrame, *, usable: int, base: int) -> DataFrame:
    """(service, batch, posts array<struct<post_id, title, content>>): what is asked about each batch of posts (service, post_id, title, content).

    A divided post is asked about in its parts, under its title; posts of a batch stand in order of post_id, and one that
    is listed twice is packed twice. Null titles are empty; a post without a service belongs to none and is left out.
    """
    p = posts.where("service is not null").select("service", "post_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    cost = text.token_count(F.concat("title", "content"))
    packed = pack_batches(p.withColumn("cost", cost), key="service", order="post_id", usable=usable, base=base)
    titles = p.groupBy("service", "post_id").agg(F.min("title").alias("title"))
    rows = packed.join(titles, ["service", "post_id"])
    return rows.groupBy("service", "batch").agg(F.array_sort(F.collect_list(F.struct("post_id", "title", "content"))).alias("posts"))


#: Crowded keys that a plan names at most.
MANY = 100


def fold_in_tasks(p: DataFrame, usable: int, base: int) -> DataFrame:
    """Each key's posts (k, o, post_id, content, cost) as one sequence within a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in zip(f["k"], f["post_id"], f["content"], f["cost"], strict=True))
        out: list[tuple] = []
        for k, own in groupby(rows, key=lambda r: r[0]):
            feed = ({"post_id": i, "content": c, "cost": n} for _, i, c, n in own)
            for number, batch in enumerate(pack_posts(feed, usable, base)):
                out += [(k, number, x["post_id"], x["content"]) for x in batch]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=["k", "batch", "post_id", "content"])
                    out = []
        yield pd.DataFrame(out, columns=["k", "batch", "post_id", "content"])

    return p.repartition("k").sortWithinPartitions("k", "o").select("k", "post_id", "content", "cost").mapInPandas(run, PACKED)


def fold_by_pointers(p: DataFrame, usable: int, base: int) -> DataFrame:
    """The same for keys of any size, in logarithmic rounds over all tasks.

    Posts over the budget cut a key into stretches. Within one, a batch that begins at a post ends before the first
    post whose running cost is over the begin's by more than the budget: that post is the begin's pointer, found in the same bucket of
    running costs, or the next, as no post costs more than a bucket is wide. The batches' begins are what pointers reach from
    the stretch's first post. Posts of no cost never begin a batch but a stretch's first, and need no pointers.
    """
    spark, room = p.sparkSession, usable - base
    root = shared.folder(spark, "pack")
    width = max(room, 1)
    rows = ordered.sequenced(spark, p, "k", ["o"], f"{root}/posts")
    light = rows.select("k", "_at", "_part", "cost", (F.col("cost") > room).cast("long").alias("big"), F.when(F.col("cost") > room, 0).otherwise(F.col("cost")).alias("own"))
    light = ordered.written(spark, ordered.running(light, "k", {"big": "stretch", "own": "total"}), f"{root}/sums")
    small = light.where("big = 0").select("k", "stretch", "_at", "own", "total")
    priced = small.where("own > 0")
    at = lambda c: F.floor(c / width).cast("long")
    found = priced.select("k", "stretch", F.col("total").alias("x"), F.lit(0).alias("asks"), F.col("_at").alias("row"), F.lit(None).cast("long").alias("at"))
    asked = priced.select("k", "stretch", (F.col("total") - F.col("own") + room).alias("x"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("row"), F.col("_at").alias("at"))
    both = found.unionByName(asked).withColumn("bucket", at(F.col("x")))
    over = Window.partitionBy("k", "stretch", "bucket").orderBy(F.desc("x"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("to", F.last("row", ignorenulls=True).over(over)).where("asks = 1").select("k", "stretch", "bucket", "at", "to")
    firsts = found.groupBy("k", "stretch", (at(F.col("x")) - 1).alias("bucket")).agg(F.min("row").alias("later"))
    same = F.col("n.k").eqNullSafe(F.col("f.k")) & (F.col("n.stretch") == F.col("f.stretch")) & (F.col("n.bucket") == F.col("f.bucket"))
    pointers = near.alias("n").join(firsts.alias("f"), same, "left").select("n.at", F.coalesce("n.to", "f.later").alias("to")).where("to is not null")
    opening = small.groupBy("k", "stretch").agg(F.min("_at").alias("_at"), F.min(F.when(F.col("own") > 0, F.col("_at"))).alias("at"))
    begins = ordered.reached(spark, opening.where("at is not null").select("at"), pointers, root)
    # the first priced post of a stretch begins nothing where posts of no cost stand before it
    begins = begins.join(opening.where("at is not null").select("at"), "at", "left_anti").unionByName(opening.select(F.col("_at").alias("at")))

    @F.pandas_udf("array<string>")
    def parts(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: sentence_parts(c or "", room - MARGIN))

    big = F.col("cost") > room
    whole = rows.join(begins.select(F.col("at").alias("_at"), F.lit(1).alias("begins")), "_at", "left")
    whole = whole.withColumn("parts", F.when(big, parts(F.when(big, F.col("content")))).otherwise(F.array("content")))
    whole = ordered.written(spark, whole.withColumn("n", F.when(big, F.size("parts")).otherwise(F.coalesce("begins", F.lit(0))).cast("long")), f"{root}/parts")
    numbered = ordered.running(whole.select("k", "_at", "_part", "n"), "k", {"n": "batches"}).select("_at", (F.col("batches") - F.greatest(F.col("n"), F.lit(1))).alias("first"), "n")
    out = whole.drop("n").join(numbered, "_at").select("k", "post_id", "first", "cost", "n", F.posexplode("parts").alias("i", "content"))
    number = F.col("first") + F.when(big, F.col("i")).otherwise(0)
    return out.select("k", number.cast("int").alias("batch"), "post_id", "content")


def sentence_chunks(text: str, size: int) -> list[str]:
    """Chunks of whole sentences up to ``size`` characters, each starting with the last sentence before."""
    if len(text) <= size:
        return [text]
    out, part, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if n + len(s) > size and part:
            out.append(" ".join(part))
            part = part[-1:] if len(part) > 1 else []
            n = sum(map(len, part))
        part.append(s)
        n += len(s)
    return out + ([" ".join(part)] if part else [])


def section_chunks(text: str, size: int) -> list[str]:
    """Chunks of whole sections: paragraphs and headed parts, two characters counted for each break."""
    out, part, n = [], [], 0
    for s in re.split(r"\n\n+|(?=^#{1,6}\s+)", text, flags=re.M):
        if n + len(s) > size and part:
            out.append("\n\n".join(part))
            part, n = [], 0
        part.append(s)
        n += len(s) + 2
    return out + ["\n\n".join(part)] if part else out


_BOUNDARY = re.compile("|".join((r"\n---+\n", r"\n\n#{1,6}\s+", r"\n\n(?:```|~~~)", r"\n\n(?:\d+\.|\*|-)\s+", r"\n\n\w")), re.M)


def boundary_chunks(text: str, size: int) -> list[str] | None:
    """Chunks that end at rules, headers, fences, lists or paragraphs; None where the text has none of them."""
    out, part, at = [], [], 0
    marks = list(_BOUNDARY.finditer(text))
    if not marks:
        return None
    for m in marks:
        piece = text[at : m.start()]
        if sum(map(len, part)) + len(piece) > size and part:
            out.append("".join(part))
            part = []
        part += [piece, m[0]]
        at = m.end()
    part.append(text[at:])
    return out + ["".join(part)] if any(part) else out


def overlap_texts(text: str, size: int, overlap: int, least: int) -> list[str]:
    if len(text) <= size:
        return [text]
    out = []
    for start in range(0, len(text), size - overlap):
        end = min(start + size, len(text))
        if end - start < least and out:
            out[-1] = text[start - (size - overlap) : end]
            break
        out.append(text[start:end])
    return out


def cut(text: str, kind: str, *, size: int, overlap: int = 500, least: int = 1000) -> list[str]:
    """Chunks of one text by sentences, sections or boundaries."""
    if kind == "sentences":
        return sentence_chunks(text, size)
    if kind == "sections":
        return section_chunks(text, size)
    found = boundary_chunks(text, size)
    return overlap_texts(text, size, min(overlap, size - 1), least) if found is None else found


def chunks(docs: DataFrame, kind: str, *, size: int, overlap: int = 500, least: int = 1000) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, text) by sentences, sections or boundaries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                parts = cut(t or "", kind, size=size, overlap=overlap, least=least)
                rows += [(d, i, len(parts), p) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "total_chunks", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, chunk_index int, total_chunks int, text string")
