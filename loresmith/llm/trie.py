"""Conversation prefix trie, rolled up by pointer jumping.

Conversations are rebuilt with the opening turns of the first conversation of their hundred. A node is
a distinct sequence of first turns; its key is a digest of its depth and of four sums over the digests of
its turns, each taken together with its place. Sums of prefixes need no fold along a conversation, so a
long one spreads over many tasks. A node's parent is what its smallest member has one turn earlier.

Leaf counts and savings rise to all ancestors by doubling: after round k a node has the totals of its
descendants less than 2^k below it; it hands them to its ancestor 2^k above, which has nothing of them
yet. That ancestor is the prefix, 2^k turns shorter, of the node's smallest member: one row of a table
with unique keys, so pointers need no joins on crowded nodes. Rounds are the logarithm of the depth.

Defined cases: null roles and texts are empty; rows of one conversation and turn stand in order of role,
first 100 characters and SHA-256 of the text; repeated rows are turns of their own; rows without a conv_id
belong to no conversation and are left out; an empty table gives no rows; other columns are ignored.
Members' numbers are joined in pieces by ranges; only the hashing of a node's pieces, which SHA-256
defines as a sequence, is one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresmith.llm import turns
from loresmith.llm.store import Stash

#: Rebuilding: conversations of one hundred share up to SHARE - 1 opening turns.
HUNDRED, SHARE = 100, 6
#: Turns of a block, within which sums run; characters of a piece of joined numbers.
BLOCK, PIECE = 1024, 1 << 16
LANES = 4
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, stash: Stash, *, share: int) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, said, chars) of the rebuilt conversations, said: a turn's digest; and (conv, size) of all of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.substring(text, 1, 100).alias("head"), F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = turns.sequenced(stash, rows.where("conv is not null"), "conv", ["turn", "role", "head", "digest"], "turns")
    held = turns.runs(rows, "conv")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(share))
    convs = held.select("conv", "_n").distinct().withColumn("h", h).withColumn("first", F.expr(f"conv - conv % {HUNDRED}"))
    convs = convs.join(convs.select(F.col("conv").alias("first"), F.col("_n").alias("_has")), "first", "left").withColumn("shared", F.least("h", F.coalesce("_has", F.lit(0))))
    convs = stash.put(convs.select("conv", "first", "h", "shared", (F.col("shared") + F.greatest(F.col("_n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "digest"), 256).alias("said")
    # where a row goes is joined to the ranges of its conversation, not to its conversation
    where = held.join(convs.select("conv", "h", "shared"), "conv").select("conv", "_part", "_shift", "h", "shared")
    own = rows.withColumn("_part", turns.part()).join(where, ["conv", "_part"]).withColumn("place", F.col("_at") + F.col("_shift"))
    own = stash.put(own.select("conv", "place", "h", "shared", said, "chars"), "placed")
    openings = own.where(F.col("place") < share - 1).select(F.col("conv").alias("first"), F.col("place").alias("pos"), "said", "chars")
    openings = convs.join(openings, "first").where(F.col("pos") < F.col("h")).select("conv", "pos", "said", "chars")
    rest = own.where("place >= h").select("conv", (F.col("shared") + F.col("place") - F.col("h")).alias("pos"), "said", "chars")
    return openings.unionByName(rest), convs.select("conv", "size")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, key, chars): every prefix of every conversation, the empty one too. chars: of its last turn."""
    lanes = [f"_l{i}" for i in range(LANES)]
    digest = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), "said"), 256)
    rows = rows.withColumn("_d", digest).select("conv", "pos", "chars", F.expr(f"pos div {BLOCK}").alias("block"), *(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(lanes)))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(*(F.sum(c).alias(c) for c in lanes))
    blocks = blocks.select("conv", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in lanes))
    within = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("conv", "block", "pos", "chars", *(F.sum(c).over(within).alias(c) for c in lanes)).join(blocks, ["conv", "block"])
    key = F.md5(F.concat_ws(",", (F.col("pos") + 1).cast("string"), *((F.col(c) + F.col(f"{c}_before")).cast("string") for c in lanes)).cast("binary"))
    filled = sums.select("conv", (F.col("pos") + 1).alias("depth"), key.alias("key"), "chars")
    return filled.unionByName(convs.select("conv", F.lit(0).cast("long").alias("depth"), F.md5(F.lit("0").cast("binary")).alias("key"), F.lit(0).cast("long").alias("chars")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most about PIECE characters of the numbers of each key, which come in order."""
    now, at, parts, held = None, None, [], 0
    out: list[tuple] = []

    def put() -> None:
        nonlocal parts, held
        if parts:
            out.append((now, at, ",".join(parts)))
        parts, held = [], 0

    for b in batches:
        for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != now or held > PIECE:
                put()
                now, at = key, conv
            parts.append(str(conv))
            held += len(parts[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "at", "piece"])
        out = []
    put()
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "at", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces, which come in order."""
    now, state, keys, found = None, None, [], []
    for b in batches:
        for key, piece in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            if key != now:
                if now is not None:
                    keys.append(now)
                    found.append(state.hexdigest())
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        keys, found = [], []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends(known: DataFrame, convs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end."""
    last = known.join(convs.select("conv", F.col("size").alias("depth")), ["conv", "depth"]).select("key", "conv")
    pieces = last.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_joined, "key string, at long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_hashed, "key string, ends_sha256 string")


def roll_up(nodes: DataFrame, known: DataFrame, columns: list[str], deepest: int, stash: Stash) -> DataFrame:
    """``nodes`` (key, conv_id, depth, columns) with each column summed over the node's subtree, itself included."""
    step = 1
    while step <= deepest:
        above = known.select(F.col("conv").alias("conv_id"), F.col("depth").alias("_up"), F.col("key").alias("_above"))
        handed = nodes.where(F.col("depth") >= step).withColumn("_up", F.col("depth") - step).join(above, ["conv_id", "_up"])
        handed = handed.groupBy(F.col("_above").alias("key")).agg(*(F.sum(c).alias(f"_{c}") for c in columns))
        done = stash.put(nodes.join(handed, "key", "left").select("key", "conv_id", "depth", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns)), f"round{step}")
        if step > 1:
            stash.drop(nodes)
        nodes, step = done, 2 * step
    return nodes


def prefix_trie(spark: SparkSession, conversations: DataFrame, *, share: int = 1) -> DataFrame:
    """A row for each distinct sequence of first turns of ``conversations`` (conv_id, turn, role, text).

    share: conversations are rebuilt with up to share - 1 turns of the first one of their hundred; 1: as they stand.
    """
    stash = Stash(spark, "trie")
    rows, convs = rebuilt(conversations, stash, share=share)
    known = stash.put(prefixes(rows, convs), "prefixes")
    nodes = known.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    above = known.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"))
    nodes = stash.put(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")  # parent edges: the root has none
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stash.put(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "edges")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select("key", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = roll_up(own, known, ["n_leaves", "saved_tokens"], deepest, stash).select("key", "n_leaves", "saved_tokens")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent", "left").join(totals, "key").join(ends(known, convs), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), share=SHARE)


QUERIES = {"op11_prefix_trie": op11_prefix_trie}


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text."""
    bit = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    table = bit.replace("xor(crc, byte)", "xor(crc & 255, byte)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: xor(crc >> 8, {table})), 4294967295)"


ORACLES = {
    "op11_prefix_trie": f"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 100), sha256(coalesce(text, ''))) - 1 AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, c - c % {HUNDRED} AS first, {crc32_sql("c::VARCHAR")} % {SHARE} AS h FROM (SELECT DISTINCT c FROM turns)),
  loose AS (SELECT convs.c, 0 AS late, place, role, text FROM convs JOIN turns ON turns.c = first WHERE place < h UNION ALL SELECT c, 1, place, role, text FROM convs JOIN turns USING (c) WHERE place >= h),
  rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY late, place) AS depth, role, text FROM loose),
  keyed AS (SELECT c, depth, text, string_agg(sha256(role || ' ' || sha256(text)), ',') OVER (PARTITION BY c ORDER BY depth) AS key FROM rebuilt
    UNION ALL SELECT c, 0, '', '' FROM convs),
  nodes AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(length(text)) AS saved FROM keyed GROUP BY key, depth),
  parents AS (SELECT n.key, up.key AS parent FROM nodes n JOIN keyed up ON up.c = n.conv_id AND up.depth = n.depth - 1),
  children AS (SELECT parent AS key, count(*) AS n_children FROM parents GROUP BY parent),
  sums AS (SELECT up.key, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE ch.key IS NULL) AS n_leaves
    FROM nodes n JOIN keyed up ON up.c = n.conv_id AND up.depth <= n.depth LEFT JOIN children ch ON ch.key = n.key GROUP BY up.key),
  finished AS (SELECT arg_max(key, depth) AS key, c FROM keyed GROUP BY c),
  members AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM finished GROUP BY key)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  coalesce(m.ends, '{NO_MEMBERS}') AS ends_sha256
FROM nodes n LEFT JOIN parents p USING (key) LEFT JOIN nodes up ON up.key = p.parent LEFT JOIN children ch ON ch.key = n.key JOIN sums s ON s.key = n.key LEFT JOIN members m ON m.key = n.key"""
}
