"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` writes each stage's result in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm import packing, quality, simhash, templates
from loresmith.llm.store import Stash, free_shuffles, mark, sweep


def _fresh(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their distance rejects go.

    Verdicts are of a row's doc_id and text, found again by two hashes of them, so that repeated rows
    share theirs. A null or empty text has no words and goes; an empty table gives no rows.
    """
    rejected = quality.judge(spark, docs).where(~F.col("kept")).select(F.col("doc_id").alias("_doc_id"), F.col("row_key").alias("_row_key")).distinct()
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r._doc_id")) & (F.xxhash64("d.doc_id", "d.text") == F.col("r._row_key"))
    return docs.alias("d").join(rejected.alias("r"), same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so do documents whose every line with a word stands word for word in an earlier document.

    A document that would lose every line, but has some that stand nowhere else word for word, keeps its text. A null
    text stays null, a text without words stays as it is, null doc_ids are one document before all others, rows of
    equal doc_id and text are one document, an empty table gives no rows.
    """
    dropped = _fresh("_dropped", docs)
    out = templates.dedup_lines(docs, dropped=dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id, null last.

    Rows of equal doc_id and different text are documents of their own; a repeated row (equal doc_id
    and text) stays once, with the first of its other columns. Empty texts are copies of each other.
    """
    groups = Stash(spark, "near_dedup").put(simhash.near_duplicates(spark, docs, shingle=5), "groups")
    key = ("doc_id", "text_hash")
    gone = groups.where(~F.col("first")).select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
    again = groups.where("first").groupBy(*key).count().where("count > 1").select(*(F.col(c).alias(f"_{c}") for c in key))
    same = lambda d: F.col(f"{d}.doc_id").cast("long").eqNullSafe(F.col("r._doc_id")) & (F.xxhash64(f"{d}.text") == F.col("r._text_hash"))
    kept = docs.alias("d").join(gone.alias("r"), same("d"), "left_anti")
    whole = F.first(F.struct(*(F.col(f"k.`{c}`") for c in docs.columns))).alias("_row")
    one = kept.alias("k").join(again.alias("r"), same("k"), "left_semi").groupBy("k.doc_id", "k.text").agg(whole).select("_row.*")
    return kept.alias("k").join(again.alias("r"), same("k"), "left_anti").unionByName(one)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row packed, in pieces of at most the capacity; a null text is an empty one, an empty table gives no rows."""
    return packing.pack_documents(spark, docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: No SQL: robust covariances, Golay keys and packing are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stash, docs = Stash(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        begin = mark()
        done = stash.put(stage(spark, docs, sf_dir), name)
        stash.drop(docs)
        sweep(spark, begin)  # the stage's own tables: its result is written
        docs = done
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
