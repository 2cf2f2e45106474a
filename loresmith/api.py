"""What a user asks: a knowledge base over a document tree, and the runs that fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresmith.functions import lookups, names, text
from loresmith.operators import extract, merge, pack, registry, render, resolve, search, validate
from loresmith.sources import tables

KINDS = {"prompting": ("prompting.md",), "parameters": ("parameters.json",), "pitfalls": ("pitfalls.md",), "all": ("prompting.md", "parameters.json", "pitfalls.md")}


def format_parameters(c: Column) -> Column:
    """Parameters JSON as markdown: an array of parameters, or settings and costs by key; the unlimited option is not shown."""
    each = F.from_json(c, "array<struct<name:string,default_value:string,recommended_range:string,description:string>>")
    line = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v, F.lit("\n"))).otherwise("")
    listed = F.array_join(F.transform(each, lambda p: F.concat(F.lit("### "), F.coalesce(p["name"], F.lit("")), F.lit("\n"), line("- Default: ", p["default_value"]), line("- Recommended: ", p["recommended_range"]), line("- ", p["description"]))), "\n")
    o = F.from_json(c, "recommended_settings map<string,struct<description:string>>, cost_optimization map<string,string>")
    told = F.array_join(F.transform(F.map_values(o["recommended_settings"]), lambda s: line("- ", s["description"])), "")
    tips = F.array_join(F.transform(F.filter(F.map_entries(o["cost_optimization"]), lambda e: e["key"].startswith("tip_")), lambda e: line("- ", e["value"])), "")
    settings = F.when(o["recommended_settings"].isNotNull(), F.concat(F.lit("### Recommended Settings\n"), told)).otherwise("")
    costs = F.when(o["cost_optimization"].isNotNull(), F.concat(F.lit("\n### Cost Optimization\n"), line("- Pricing: ", F.element_at(o["cost_optimization"], "pricing")), tips)).otherwise("")
    return F.when(F.trim(c).startswith("["), listed).otherwise(F.concat(settings, costs))


class KnowledgeBase:
    """Questions to a tree (category, slug, file, content)."""

    def __init__(self, spark: SparkSession, tree: DataFrame | str):
        self.spark = spark
        self.tree = tables.corpus(spark, tree) if isinstance(tree, str) else tree

    @property
    def entries(self) -> DataFrame:
        """(ord, name, category): one row an entry; ord orders by category and name, without numbering all rows in one task."""
        return self.tree.select(F.struct("category", F.col("slug").alias("name")).alias("ord"), F.col("slug").alias("name"), "category").distinct()

    def list_entries(self, category: str | None = None) -> DataFrame:
        e = self.entries.select("category", "name")
        return (e.where(F.col("category") == category) if category and category != "all" else e).orderBy("category", "name")

    def search(self, query: str, k: int = 10) -> DataFrame:
        """Nearest names to a query."""
        return search.top_matches(self._asked(query), self.entries, k).select("name", "category", "similarity", "match_type", "rank").orderBy("rank")

    def find(self, part: str, limit: int = 10) -> DataFrame:
        return search.substring(self.entries, part, limit).select("category", "name")

    def suggest(self, query: str, k: int = 3) -> DataFrame:
        return search.suggestions(self._asked(query), self.entries, k)

    def best_practices(self, name: str, kind: str = "all") -> DataFrame:
        """(name, match_type, similarity, file, content) of the entry that a name means; parameters as markdown."""
        hit = search.best_match(self._asked(name), self.entries).select("name", "match_type", "similarity")
        docs = self.tree.where(F.col("file").isin(*KINDS[kind])).select(F.col("slug").alias("name"), "category", "file", "content")
        first = docs.groupBy("name", "file").agg(F.min_by("content", "category").alias("content"))
        shown = F.when(F.col("file") == "parameters.json", format_parameters(F.col("content"))).otherwise(F.col("content"))
        return hit.join(first, "name").select("name", "match_type", "similarity", "file", shown.alias("content"))

    def info(self, category: str, slug: str, width: int = 300) -> DataFrame:
        """(file, shown): the head of each file of an entry."""
        return self.tree.where((F.col("category") == category) & (F.col("slug") == slug)).select("file", F.substring("content", 1, width).alias("shown")).orderBy("file")

    def recommend(self, use_case: str) -> DataFrame:
        if use_case not in lookups.USE_CASES:
            raise ValueError(f"use cases: {', '.join(lookups.USE_CASES)}")
        return search.recommend(self.spark, self.entries).where(F.col("use_case") == use_case)

    def counts(self) -> DataFrame:
        """Entries by category, and in all (null)."""
        return self.entries.rollup("category").agg(F.count(F.lit(1)).alias("n"))

    def manifest(self) -> DataFrame:
        return render.manifest(self.tree)

    def findings(self, as_of: str) -> DataFrame:
        return validate.corpus_findings(self.tree, as_of)

    def export(self, fmt: str = "json", category: str | None = None, model: str | None = None) -> DataFrame:
        """(category, content): a JSON object, a YAML map or a markdown document of each category."""
        t = self.tree
        t = t.where(F.col("category") == category) if category else t
        t = t.where(F.col("slug") == model) if model else t
        if fmt == "json":
            return render.export_json(t)
        rows = F.array_sort(F.collect_list(F.struct("slug", "file", "content")))
        if fmt == "markdown":
            one = lambda x: F.concat(F.lit("## "), x["slug"], F.lit(" / "), x["file"], F.lit("\n\n"), x["content"], F.lit("\n"))
            head = F.concat(F.lit("# "), F.col("category"), F.lit("\n\n"))
        elif fmt == "yaml":
            one = lambda x: F.concat(F.lit('"'), x["slug"], F.lit("/"), x["file"], F.lit('": '), F.to_json(F.array(x["content"])), F.lit("\n"))
            head = F.lit("")
        else:
            raise ValueError("formats: json, yaml, markdown")
        return t.groupBy("category").agg(rows.alias("r")).select("category", F.concat(head, F.array_join(F.transform("r", one), "\n" if fmt == "markdown" else "")).alias("content"))

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(query,)], "query string")


def discover(lists: DataFrame, ordinal: str = "pos") -> DataFrame:
    """Registry of the services of curated lists (source, content)."""
    found = tables.discover(lists)
    order = F.row_number().over(Window.orderBy("source", "form", ordinal)).cast("long")  # a few thousand entries of lists
    return registry.fold(found.withColumn("ord", order))


def run_extraction(posts: DataFrame, make: Callable[[], extract.Extractor], *, usable: int = 2396, base: int = 400) -> DataFrame:
    """Pack the posts of each service (service, post_id, title, content) and ask the extractor; write before reuse."""
    return extract.extract(pack.asked(posts, usable=usable, base=base), make)


def build_tree(results: DataFrame, day: str, services: DataFrame | None = None, static: DataFrame | None = None) -> DataFrame:
    """Document tree of extraction results (service, batch, lists, batch_size): merged by service and rendered."""
    lists = F.array(*(F.struct(F.lit(n).alias("list_name"), F.col(n).alias("items")) for n in merge.LISTS))
    at = F.row_number().over(Window.partitionBy(F.lower("service")).orderBy("batch", "service")).cast("long")
    r = results.withColumn("_at", at).select("_at", "service", "batch_size", F.posexplode(lists).alias("k", "l")).select("*", F.posexplode_outer("l.items").alias("i", "item"))
    items = r.select(
        (F.col("_at") * (1 << 32) + F.col("k") * (1 << 24) + F.coalesce("i", F.lit(0))).alias("ord"), "service", "l.list_name", "item",
        F.when((F.col("k") == 0) & (F.coalesce("i", F.lit(0)) == 0), F.col("batch_size").cast("long")).otherwise(0).alias("batch_size"), F.lit(day).alias("ts"),
    )
    merged = merge.merge_by_service(items)
    if services is not None:
        known = resolve.match_services(merged.select(F.col("service").alias("query")).distinct(), services, static)
        merged = merged.join(known.select(F.col("query").alias("service"), F.col("category").alias("_known")), "service", "left")
    else:
        merged = merged.withColumn("_known", F.lit(None).cast("string"))
    return render.files(merged.withColumn("category", names.fallback_category(F.col("service"), F.col("_known"))), day)
