"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label are one class with a multiplicity. On a bounded sample of classes
(``SAMPLE`` and ``SAMPLE_BYTES``, those of the smallest hashed ids) principal axes and rotations are learned: each is a
random orthogonal matrix that alternates with the sign codes it gives until the codes are near the data.
Codes are centred, and so balanced, if pairs at the threshold, made of the sample's vectors, then still have near
codes (``RECALL``); where the vectors lie far to one side of the origin they would not, and planes
through the origin are used, whose bits differ in proportion to the angle.

A code is cut into substrings, one for each table. Codes within ``reach`` bits agree in some substring but
for twice ``radius`` bits at most (pigeonhole), so they share a point within ``radius`` bits of both
substrings: a class stands in a table under all points of that ball around its substring, and classes that share
one are candidates if their whole codes are within the reach. Only ids and codes are shuffled so. A pair counts
in the first table and the least point that bring it together, so it is a candidate once. Candidates
are then reranked by the cosine of the original vectors in double precision.

A point that more than ``BLOCK`` classes share is dealt out: its classes are split into blocks and each pair of
blocks is a group of its own, so no group is larger than two blocks whatever share of the rows
one point has, and none of its pairs is left out.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null label or null vec_id, link with nothing; vectors of different length do not
compare; a repeated row is one more vector, and a vec_id that stands with several vectors or labels names several; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm.graph import components
from loresmith.llm.simhash import _spanning
from loresmith.llm.store import Stash

THRESHOLD = 0.93
SAMPLE, SAMPLE_BYTES, ROUNDS, AXES, LEARNED, LONGEST = 20_000, 64_000_000, 30, 64, 100, 4096
RECALL, SIGMAS, LEAST_BITS, MOST_BITS, PER_POINT, BLOCK, SMALL, CONNECTED = 0.97, 2.0, 16, 30, 64, 2048, 64, 1_000_000


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int, int, int]:
    """(bits of a substring, tables, radius, reach) for n vectors of the largest label.

    The reach lies ``SIGMAS`` deviations over the mean of differing bits at the threshold; closer pairs are surer.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / PER_POINT))))
    p = math.acos(threshold) / math.pi
    for radius in range(1, bits):
        for tables in range(2, 13):
            reach = (2 * radius + 1) * tables - 1
            if reach >= tables * bits * p + SIGMAS * math.sqrt(tables * bits * p * (1 - p)):
                return bits, tables, radius, reach
    raise ValueError("no tables for this threshold")


@lru_cache(8)
def ball(bits: int, radius: int) -> np.ndarray:
    """What to flip in a substring for each point within the radius."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.int64)


def unit(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length as unit vectors; scaled first, so that no square overflows."""
    x = np.stack(rows)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Codes of unit vectors of one length: learned on a sample, else by random planes."""

    def __init__(self, dims: int, bits: int, sample: np.ndarray | None = None, threshold: float = THRESHOLD, reach: int = 0, seed: int = 7):
        self.dims, self.bits, self.seed = dims, bits, seed
        self.mean = self.axes = None
        if sample is None or len(sample) < LEARNED or dims > LONGEST:
            return
        for mean in (sample.mean(axis=0), np.zeros(dims)):
            self.mean, self.axes = mean, self._learn(sample - mean)
            if self._kept(sample[:2000], threshold, reach) >= RECALL:
                break

    def _learn(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        _, _, axes = np.linalg.svd(x.T @ x)
        axes = axes[:AXES].T
        v, out = x @ axes, []
        while sum(a.shape[1] for a in out) < self.bits:
            r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            out.append(axes @ r)
        return np.concatenate(out, axis=1)[:, : self.bits]

    def _kept(self, x: np.ndarray, threshold: float, reach: int) -> float:
        """Share of pairs at the threshold whose codes are within the reach."""
        rng = np.random.default_rng(self.seed + 1)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        other = threshold * x + math.sqrt(1 - threshold**2) * away
        return float(((self.on(x) != self.on(other)).sum(axis=1) <= reach).mean())

    def on(self, x: np.ndarray) -> np.ndarray:
        if self.axes is not None:
            return (x - self.mean) @ self.axes >= 0
        total = np.zeros((len(x), self.bits))
        for at in range(0, self.dims, 4096):  # planes by parts: long vectors need no large matrix
            part = x[:, at : at + 4096]
            total += part @ np.random.default_rng((self.seed, at)).normal(size=(part.shape[1], self.bits))
        return total >= 0

    def substrings(self, x: np.ndarray, tables: int) -> np.ndarray:
        """(rows, tables) substrings of the codes."""
        on = self.on(x).reshape(len(x), tables, -1)
        return on @ (1 << np.arange(on.shape[2], dtype=np.int64))


def _once(i: np.ndarray, j: np.ndarray, table: np.ndarray, point: np.ndarray, subs: np.ndarray, bits: int, radius: int, reach: int) -> np.ndarray:
    """Which pairs of rows are within the reach and meet here first: no earlier table, no lesser point."""
    apart = np.bitwise_count(subs[i] ^ subs[j])
    fit = np.flatnonzero(apart.sum(axis=1, dtype=np.int64) <= reach)
    if not len(fit):
        return fit
    first = (apart[fit] <= 2 * radius).argmax(axis=1)
    fit = fit[first == table[i[fit]]]
    out = []
    for at in range(0, len(fit), 20_000):
        part = fit[at : at + 20_000]
        t = table[i[part]]
        points = subs[i[part], t][:, None] ^ ball(bits, radius)
        shared = np.bitwise_count(points ^ subs[j[part], t][:, None]) <= radius
        out.append(part[np.where(shared, points, 1 << 62).min(axis=1) == point[i[part]]])
    return np.concatenate(out) if out else fit


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    stash = Stash(spark, "embeddings")
    # eight-byte components: what is compared is what is stored
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    valid = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    classes = stash.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbers of their own: vec_ids may repeat
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.size("v") <= LONGEST, F.size("v"))).alias("dims")).agg(F.max("n"), F.max("dims")).first()
    bits, tables, radius, reach = plan(sizes[0] or 0, threshold)
    most = min(sample, SAMPLE_BYTES // (8 * (sizes[1] or 1)))
    seen = classes.where(F.size("v") <= LONGEST).orderBy(F.xxhash64("least"), "cid").limit(most).select("v").toPandas()["v"]
    by_dims: dict[int, list] = {}
    for v in seen:
        by_dims.setdefault(len(v), []).append(np.asarray(v, float))
    learned = {d: Quantiser(d, bits * tables, unit(vs), threshold, reach) for d, vs in by_dims.items() if len(vs) >= LEARNED}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = ball(bits, radius)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                of = np.array(part.column(2).value_lengths())
                for dims in np.unique(of).tolist():
                    own = np.flatnonzero(of == dims)
                    x = unit([np.asarray(part.column(2)[int(i)].values.to_numpy(zero_copy_only=False), float) for i in own])
                    q = learned.get(dims) or Quantiser(dims, bits * tables)
                    subs = q.substrings(x, tables)
                    code = [c.tobytes() for c in subs.astype("<i4")]
                    points = (subs[:, :, None] ^ flips).reshape(-1)
                    row = np.repeat(own, tables * len(flips))
                    take = lambda c, r: c.take(pa.array(r))
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), len(flips)), len(own))
                    yield pa.RecordBatch.from_arrays(
                        [take(part.column(0), row), pa.array(table), pa.array(points.astype(np.int32)), take(part.column(1), row), pa.array(code, pa.binary()).take(pa.array(np.repeat(np.arange(len(own)), tables * len(flips))))],
                        names=["lab", "tab", "point", "cid", "code"],
                    )

    coded = classes.select(F.xxhash64("label", F.size("v")).alias("lab"), "cid", "v")
    met = coded.mapInArrow(emit, "lab long, tab int, point int, cid long, code binary").withColumn("g", F.xxhash64("lab", "tab", "point"))
    large = met.groupBy("g").count().where(F.col("count") > BLOCK)
    large = stash.put(large.select("g", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    met = met.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select(F.when(F.col("blocks") == 1, F.col("g")).otherwise(F.xxhash64("g", low, high)).alias("g"), "lab", "tab", "point", "cid", "code", F.when(low == high, 0).otherwise(1 + (F.col("block") == low).cast("int")).alias("side"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n_parts, "g").sortWithinPartitions("g")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(g, lab, tab, point, cid, side, subs) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[start, len(g)])
            a, b = [], []

            def keep(i, j):
                # side 0: a group of its own; else two blocks, of which only pairs across count here
                fit = (lab[i] == lab[j]) & (tab[i] == tab[j]) & (point[i] == point[j]) & ((side[i] == 0) | (side[i] != side[j]))
                i, j = i[fit], j[fit]
                once = _once(i, j, tab, point, subs, bits, radius, reach)
                a.append(i[once])
                b.append(j[once])

            at, step = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size)), 1
            while len(at):
                at = at[at + step < len(g)]
                at = at[g[at] == g[at + step]]
                keep(at, at + step)
                step += 1
            for k in np.flatnonzero(size > SMALL):
                whole = np.arange(start[k], start[k] + size[k])
                for i in whole:
                    near = np.bitwise_count(subs[whole[whole > i]] ^ subs[i]).sum(axis=1, dtype=np.int64) <= reach
                    j = whole[whole > i][near]
                    if len(j):
                        keep(np.full(len(j), i), j)
            none = [np.zeros(0, np.int64)]
            a, b = np.concatenate([*none, *a]).astype(np.int64), np.concatenate([*none, *b]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("g", "lab", "tab", "point", "cid", "side")]
            raw = batch.column("code")
            subs = np.frombuffer(b"".join(raw.to_pylist()), "<i4").reshape(-1, tables).astype(np.int64)
            held.append([*cols[:3], cols[3].astype(np.int64), *cols[4:], subs])
            n += batch.num_rows
            if n < 100_000:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            tail = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
            if tail:
                yield pairs(*(w[:tail] for w in whole))
            held, n = [[w[tail:] for w in whole]], len(whole[0]) - tail
        if held:
            yield pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))

    near = stash.put(met.select("g", "lab", "tab", "point", "cid", "side", "code").mapInArrow(meet, "a long, b long"), "near")
    end = lambda x: classes.select(F.col("cid").alias(x), F.col("v").alias(f"v{x}"), F.col("times").alias(f"t{x}"), F.col("label").alias(f"l{x}"))
    both = near.join(end("a"), "a").join(end("b"), "b").where((F.col("la") == F.col("lb")) & (F.size("va") == F.size("vb"))).select("a", "ta", "va", "b", "tb", "vb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(who: list, times: list, forest: list) -> pa.RecordBatch:
            """Links by vector, and a forest of them."""
            none = [np.zeros(0, np.int64)]
            ids, place = np.unique(np.concatenate(none + who), return_inverse=True)
            n = np.bincount(place, np.concatenate(none + times), len(ids)).astype(np.int64)
            cols = (ids.tolist() + [None] * len(forest), n.tolist() + [None] * len(forest), [None] * len(ids) + [p for p, _ in forest], [None] * len(ids) + [q for _, q in forest])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cid", "n", "a", "b"])

        connected: dict[int, int] = {}  # by earlier links of this task
        who, times, forest, waiting = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if len(connected) > CONNECTED:
                    connected.clear()
                a, ta, b, tb = (part.column(c).to_numpy() for c in ("a", "ta", "b", "tb"))
                of = np.array(part.column("va").value_lengths())
                cos = np.zeros(len(a))
                for dims in np.unique(of).tolist():
                    own = np.flatnonzero(of == dims)
                    x, y = (unit([np.asarray(part.column(c)[int(i)].values.to_numpy(zero_copy_only=False), float) for i in own]) for c in ("va", "vb"))
                    cos[own] = (x * y).sum(axis=1)
                ok = cos >= threshold
                who.append(np.r_[a[ok], b[ok]])
                times.append(np.r_[tb[ok], ta[ok]])
                forest += _spanning(a[ok], b[ok], connected)
                waiting += len(who[-1])
                if waiting > CONNECTED:
                    yield send(who, times, forest)
                    who, times, forest, waiting = [], [], [], 0
        yield send(who, times, forest)

    found = stash.put(both.mapInArrow(rerank, "cid long, n long, a long, b long"), "found")
    counts = found.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(stash, found.where("a is not null").select("a", "b"))
    rooted = classes.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").join(counts, "cid", "left")
    named = stash.put(named.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"), "named")
    good = rows.where("ok").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(rest)


def op7_itq_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_itq_embedding_dedup": op7_itq_embedding_dedup}
#: Brute force: every pair of a label, and all that chains of links reach.
ORACLES = {
    "op7_itq_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
  links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
  reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, min(y) AS component_id, v.vec_id = min(y) AS kept FROM v JOIN reach ON x = v.vec_id GROUP BY v.vec_id"""
}
