"""Hierarchical Pitman-Yor language model over words.

Every context (the word before) is a restaurant whose customers are the words that follow it; all
context restaurants share one parent, the root restaurant, whose base is uniform over the training
vocabulary and one unknown word. Seating is sampled by Gibbs: a customer leaves, its table closes
if it sat alone (the chance of which, given customers and tables of a dish, is a ratio of
generalised Stirling numbers), and it sits down again at an old table or, in proportion to the
parent's probability, at a new one, which is a customer of the parent. A word's probability is the
mean of the predictive probabilities over the samples taken.

The work is dealt by (context, word): map tasks turn batches of texts into sorted arrays of the
n-gram types for each bucket, with the places that hold them; a bucket keeps all batches' arrays.
Contexts are whole within a bucket, but those of a large share of all tokens (found on a sample
that decides placement only) are split by word over several buckets, whose totals are summed.
Words meet their root seating in buckets by word; those replies are joined to the buckets kept,
which are written once as a bucketed table and never shuffled again. Seating in different
restaurants is sampled in parallel given the parent's last state. Nothing that grows with the
corpus reaches the driver: counts do, and the contexts of a share over 1/(4 buckets), at most four
a bucket.

Defined cases: a null text is empty, an empty text is its end alone; a null doc_id counts as the
text "null" for its fold; repeated rows train and are scored each for itself; without training
rows every word has the base's probability; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm.store import Stash, free_shuffles

FOLDS, HELD = 7, 2
#: Discounts and strengths of the root and of context restaurants.
ROOT_D, ROOT_THETA, D, THETA = 0.75, 10.0, 0.80, 1.0
#: Gibbs steps before the first sample, between samples, and samples.
BURN, GAP, SAMPLES, ROOT_SAMPLES, ROUNDS = 6, 3, 3, 2, 2
#: Text bytes to a bucket; tokens and texts of a batch; one text in so many decides the placement of contexts.
BUCKET_BYTES, BATCH_TOKENS, BATCH_DOCS, PLACING = 6_000_000, 1_500_000, 60_000, 64
#: Buckets of batches' headers, and the most buckets of types.
HEADERS, MOST_BUCKETS = 1 << 20, (1 << 22) - 1
#: Words are the low 48 bits of their XXH3; two ids stand for the start and the end of a text.
MASK, START, END = (1 << 48) - 1, (1 << 48) - 2, (1 << 48) - 1
STIRLING = 96


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads ids over buckets."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def short(x: np.ndarray) -> bytes:
    """Counts from 1 as a byte each; those of 255 and more follow whole."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u4").tobytes()


def unshort(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    if len(raw) > n:
        out[out == 255] = np.frombuffer(raw[n:], "<u4")
    return out


def word_ids(text: str | None) -> np.ndarray:
    """Ids of a text's words, and its end."""
    import xxhash

    ids = np.frombuffer(array("Q", map(xxhash.xxh3_64_intdigest, (text or "").encode().lower().split())), np.uint64) & np.uint64(MASK)
    return np.append(np.minimum(ids, np.uint64(START - 1)), np.uint64(END))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def word_buckets(buckets: int) -> int:
    """Buckets of the root's words: so few that messages grow with the power 1.5 of the buckets, not their square."""
    return min(buckets, math.ceil(4 * math.sqrt(buckets)))


class Placement:
    """Bucket of a type: by its context, and by its word too where the context is heavy."""

    def __init__(self, buckets: int, heavy: dict[int, int]):
        self.buckets = buckets
        self.word_buckets = word_buckets(buckets)
        self.ids = np.array(sorted(heavy), np.uint64)
        self.wings = np.array([heavy[int(u)] for u in self.ids], np.uint64)

    def heavy(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is heavy, its number among the heavy)."""
        if not len(self.ids):
            return np.zeros(len(u), bool), np.zeros(len(u), np.int64)
        at = np.minimum(np.searchsorted(self.ids, u), len(self.ids) - 1)
        return self.ids[at] == u, at

    def __call__(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        h = mix(u)
        is_heavy, at = self.heavy(u)
        if is_heavy.any():
            wing = mix(w[is_heavy]) % self.wings[at[is_heavy]]
            h[is_heavy] = mix(h[is_heavy] + (wing + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019))
        return (h % np.uint64(self.buckets)).astype(np.int64)


def by_word(w: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(w ^ np.uint64(0x5555)) % np.uint64(buckets)).astype(np.int64)


@lru_cache(4)
def _stirling(d: float) -> tuple[np.ndarray, np.ndarray]:
    """[c, t]: logarithms of the generalised Stirling numbers, and the chance that one of c customers at t tables sits alone."""
    logs = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    logs[0, 0] = 0.0
    out = np.zeros((STIRLING + 1, STIRLING + 1))
    with np.errstate(divide="ignore"):
        for c in range(1, STIRLING + 1):
            t = np.arange(1, c + 1)
            stay = logs[c - 1, t] + np.log(np.maximum(c - 1 - d * t, 0))
            logs[c, t] = np.logaddexp(logs[c - 1, t - 1], stay)
            out[c, t] = np.exp(logs[c - 1, t - 1] - logs[c, t])
    return logs, out


def _alone(d: float) -> np.ndarray:
    """[c, t]: chance that one of c customers at t tables of a dish sits alone."""
    return _stirling(d)[1]


@lru_cache(4)
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of customers a table less one, and of a table's chance to be a lone customer's, along the saddle points.

    The numbers are coefficients of powers of f(z) = (1 - (1 - z)^d) / d; at the point where z f'(z) / f(z)
    is the customers a table, their ratio is z / f(z).
    """
    y = np.r_[-np.geomspace(200, 0.01, 6000), np.log1p(-np.geomspace(0.0099, 1e-7, 2000))]  # log(1 - z)
    z, f = -np.expm1(y), -np.expm1(d * y) / d
    ratio = z * np.exp((d - 1) * y) / f
    order = np.argsort(ratio)
    return np.log(np.maximum(ratio - 1, 1e-12))[order], np.log(z / f)[order]


def _alone_large(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """By saddle points, for many customers: exact at one table and at one customer a table."""
    less = np.maximum(t - 1.0, 1e-9)
    x, y = _saddle(d)
    return np.where(t <= 1, 0.0, less / (c - 1) * np.exp(np.interp(np.log(np.maximum((c - 1) / less - 1, 1e-12)), x, y)))


def alone(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """As above for any counts: beyond the table by saddle points."""
    small = c <= STIRLING
    out = _alone_large(np.maximum(c, 2), t, d)
    out[small] = _alone(d)[c[small], t[small]]
    return out


def gibbs_step(rng, c, t, parent, tables, d, theta) -> np.ndarray:
    """One customer of every dish leaves and sits down again. tables: T of each dish's restaurant."""
    leave = rng.random(len(c)) < alone(c, t, d)
    rest = t - leave
    new = (theta + d * (tables - leave)) * parent
    back = rng.random(len(c)) < new / (new + (c - 1) - d * rest)
    return rest + back


def draw_tables(rng, c, t, parent, tables, d, theta) -> np.ndarray:
    """Tables of every dish (two customers at least) drawn anew, given the other dishes' tables: all its customers at once.

    The chance of t tables is in proportion to S(c, t) parent^t (theta + d others) ... (theta + d (others + t - 1)).
    tables: T of each dish's restaurant.
    """
    out = np.array(t, np.int64)
    parent = np.broadcast_to(np.asarray(parent, float), out.shape)
    base = theta + d * (tables - t)
    small = np.flatnonzero(c <= STIRLING)
    logs = _stirling(d)[0]
    for at in np.array_split(small, max(1, len(small) // 100_000)):
        if not len(at):
            continue
        n = c[at]
        end = np.cumsum(n)
        k = np.arange(end[-1]) - np.repeat(end - n, n)  # tables less one
        own = np.repeat(np.arange(len(at)), n)
        step = np.log((base[at][own] + d * k) * parent[at][own])
        run = np.cumsum(step)
        run -= np.repeat(run[end - n] - step[end - n], n)
        run += logs[n[own], k + 1]
        w = np.exp(run - np.repeat(np.maximum.reduceat(run, end - n), n))
        upto = np.cumsum(w)
        before = upto[end - n] - w[end - n]
        pick = np.searchsorted(upto, before + rng.random(len(at)) * (upto[end - 1] - before))
        out[at] = np.clip(pick - (end - n), 0, n - 1) + 1
    at = np.flatnonzero(c > STIRLING)
    if len(at):
        out[at] = _draw_large(rng, c[at].astype(float), parent[at], base[at], d)
    return out


def _slope(t, c, parent, base, d) -> np.ndarray:
    """log of the chance of t tables over that of t - 1; t from 2 on, not always whole."""
    up = np.log((base + d * (t - 1)) * parent) + np.log1p(-np.minimum(_alone_large(c, t - 1, d), 1 - 1e-12))
    return up - np.log(np.maximum(c - 1 - d * (t - 1), 1e-9) * np.maximum(_alone_large(c, t, d), 1e-300))


POINTS = 96


def _draw_large(rng, c, parent, base, d) -> np.ndarray:
    """The same for dishes of many customers: whole where the chances spread over few counts, else by points between."""
    lo, hi = np.full(len(c), 2.0), c.copy()
    for _ in range(48):  # the chances have one peak: their slope falls
        mid = (lo + hi) / 2
        up = _slope(mid, c, parent, base, d) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    peak = (lo + hi) / 2
    wide = np.maximum(1.0, 0.3 * np.sqrt(peak))
    a, b = np.maximum(peak - wide, 2.0), np.minimum(peak + wide, c)
    fall = (_slope(a, c, parent, base, d) - _slope(b, c, parent, base, d)) / np.maximum(b - a, 1e-9)
    sd = np.clip(1 / np.sqrt(np.maximum(fall, 1e-12)), 1.0, np.maximum(peak, 4.0))
    stride = np.ceil(np.maximum(14 * sd, POINTS) / POINTS)
    first = np.clip(np.floor(peak - stride * POINTS / 2), 1, None)
    t = first[:, None] + stride[:, None] * np.arange(POINTS)
    fits = t <= c[:, None]
    inner = np.minimum(t[:, 1:] - (stride[:, None] - 1) / 2, c[:, None])
    steps = stride[:, None] * _slope(np.maximum(inner, 2.0), c[:, None], parent[:, None], base[:, None], d)
    run = np.where(fits, np.cumsum(np.c_[np.zeros(len(c)), steps], axis=1), -np.inf)
    upto = np.cumsum(np.exp(run - run.max(axis=1, keepdims=True)), axis=1)
    pick = (upto < (rng.random(len(c)) * upto[:, -1])[:, None]).sum(axis=1)
    found = first + stride * pick + np.where(stride > 1, np.floor((rng.random(len(c)) - 0.5) * stride), 0)
    return np.clip(found, 1, c).astype(np.int64)


SEATING = 32


def sit_down(c, ctx, n, parent, d, theta, more=None) -> np.ndarray:
    """A first seating: tables expected when all customers of n restaurants come in turn, in steps of growing length.

    ctx: each dish's restaurant; more: a restaurant's tables in all over those seen here.
    """
    out, many = np.minimum(c, 1), np.flatnonzero(c > 1)
    if not len(many):
        return out
    lone = np.bincount(ctx[c == 1], minlength=n)
    more = np.ones(n) if more is None else np.broadcast_to(more, n)
    c, ctx, parent = c[many], ctx[many], np.broadcast_to(parent, len(out))[many]
    before, t, total = 0.0, np.zeros(len(c)), np.zeros(n)
    for share in np.geomspace(1 / c.max(), 1, SEATING):
        sat, now = np.maximum(c * before, 1), c * share
        come = np.maximum(now - sat, 0)
        start, guess, then = np.maximum(t, np.minimum(now, 1)), t, total
        for _ in range(2):  # once by the tables before the step, once by those amid it
            new = (theta + d * (total + then) / 2 * more)[ctx] * parent
            rest = np.maximum(sat + come / 2 - d * (start + np.maximum(guess, start)) / 2, 1 - d)
            guess = np.minimum(start + come * new / (new + rest), np.maximum(now, start))
            then = np.bincount(ctx, guess, n) + lone * share
        before, t, total = share, guess, then
    out[many] = np.clip(np.rint(t), 1, c)
    return out


# --- batches: the types of many texts, by bucket


def batch_rows(docs: list, held: list[bool], tokens: list[np.ndarray], batch: int, place: Placement):
    """Rows (bucket, batch, uu, un, w, held, n, at) of a batch, and its header in a bucket below 0.

    uu, un: contexts and how many types each has; w: the types' words; n: places of each type;
    at: the texts of the places, type by type; held: a bit for each text of the batch.
    """
    size = np.array([len(x) for x in tokens])
    w = np.concatenate(tokens)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.r_[0, np.cumsum(size)[:-1]]] = START
    bucket = place(u, w).astype(np.uint32)
    key = bucket.astype(np.uint64) << np.uint64(42)
    key |= (mix(u) & np.uint64(0x1FFFFF)) << np.uint64(21)
    key |= mix(w) & np.uint64(0x1FFFFF)
    order = np.argsort(key)
    del key
    u, w, bucket = u[order], w[order], bucket[order]
    at = np.repeat(np.arange(len(size), dtype=np.uint16), size)[order]
    del order
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
    ends = np.r_[first, len(w)]
    n = np.diff(ends)
    u, w, bucket = u[first], w[first], bucket[first]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    bits = np.packbits(np.array(held, bool)).tobytes()
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        run = np.flatnonzero(np.r_[True, u[i + 1 : j] != u[i : j - 1]])
        yield (int(bucket[i]), batch, six(u[i:j][run]), short(np.diff(np.r_[run, j - i])), six(w[i:j]), bits, short(n[i:j]), at[ends[i] : ends[j]].tobytes())
    ids = np.array([0 if x is None else x for x in docs], "<i8").tobytes()
    marks = np.array(held, np.uint8) | np.array([2 * (x is None) for x in docs], np.uint8)
    yield (-1 - int(mix(np.array([batch], np.uint64))[0] % np.uint64(HEADERS)), batch, ids, marks.tobytes(), size.astype("<u4").tobytes(), None, None, None)


BATCH = "bucket int, batch long, uu binary, un binary, w binary, held binary, n binary, at binary"


def batches_of(docs: DataFrame, place: Placement) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        ids, held, tokens, n = [], [], [], 0

        def send():
            rows = list(zip(*batch_rows(ids, held, tokens, (task << 24) | k, place), strict=True))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
            names = [f.split()[0] for f in BATCH.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

        for b in arrow:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc)
                held.append(is_held_out(doc))
                tokens.append(word_ids(text.as_py()))
                n += len(tokens[-1])
                if n >= BATCH_TOKENS or len(ids) >= BATCH_DOCS:
                    yield send()
                    k, ids, held, tokens, n = k + 1, [], [], [], 0
        if ids:
            yield send()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BATCH)


def heavy_contexts(docs: DataFrame, buckets: int) -> dict[int, int]:
    """Contexts of over 1/(4 buckets) of the tokens of a sample of texts, and their wings: at most four a bucket."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {-1: 0}  # -1: tokens in all
        send = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["u", "n"])
        for b in arrow:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if zlib.crc32(str(doc).encode()) % PLACING == 0:
                    ids = word_ids(text.as_py())
                    total[-1] += len(ids)
                    for u, n in zip(*(x.tolist() for x in np.unique(np.r_[np.uint64(START), ids[:-1]], return_counts=True)), strict=True):
                        total[u] = total.get(u, 0) + n
            if len(total) > 500_000:
                yield send()
                total = {-1: 0}
        yield send()

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "u").limit(4 * buckets + 1).collect()  # no more contexts can have such a share
    of = max(1, next((r["n"] for r in top if r["u"] == -1), 1))
    return {r["u"]: math.ceil(r["n"] / of * 4 * buckets) for r in top if r["u"] != -1 and r["n"] * 4 * buckets > of}


# --- a bucket: all batches' types merged


class Bucket:
    """The merged types of a bucket. u, w, c by type; of: each batch's types as numbers among them."""

    def __init__(self, parts: list[dict]):
        us = [np.repeat(unsix(p["uu"]), unshort(p["un"], len(p["uu"]) // 6)) for p in parts]
        ws = [unsix(p["w"]) for p in parts]
        u, w = np.concatenate(us), np.concatenate(ws)
        del us
        self.n = [unshort(p["n"], len(x)) for p, x in zip(parts, ws, strict=True)]
        self.at = [np.frombuffer(p["at"], "<u2") for p in parts]
        trains = [1 - np.unpackbits(np.frombuffer(p["held"], np.uint8)) for p in parts]
        c = np.concatenate([np.add.reduceat(t[a], np.cumsum(n) - n, dtype=np.int64) for t, a, n in zip(trains, self.at, self.n, strict=True)])
        key, first, inverse = np.unique(mix(u) + w * np.uint64(0x9FB21C651E98DF25), return_index=True, return_inverse=True)
        self.u, self.w = u[first], w[first]
        self.c = np.bincount(inverse, c, len(key)).astype(np.int64)
        self.of = np.split(inverse, np.cumsum([len(x) for x in ws])[:-1])
        self.contexts, self.ctx = np.unique(self.u, return_inverse=True)
        self.words, self.word = np.unique(self.w, return_inverse=True)

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order of their buckets, and where each bucket's begin."""
        b = by_word(self.words, buckets)
        order = np.argsort(b, kind="stable")
        return order, np.searchsorted(b[order], np.arange(buckets + 1))

    def seat(self, place: Placement, totals: np.ndarray | None, parent: np.ndarray | None, samples: int, seed: int):
        """Yields (t, tables of each type's restaurant) for each sample; the first seating without a parent."""
        t = np.minimum(self.c, 1)
        T = np.bincount(self.ctx, t, len(self.contexts))
        is_heavy, at = place.heavy(self.contexts)
        beyond = np.zeros(len(self.contexts))  # tables of a heavy context in other buckets
        if totals is not None and is_heavy.any():
            first = np.maximum(totals[at[is_heavy], 1], 1)  # this bucket's share of the first seating's tables
            beyond[is_heavy] = totals[at[is_heavy], 2] * (1 - T[is_heavy] / first)
        if parent is None:
            yield t, (T + beyond)[self.ctx]
            return
        more = 1 + beyond / np.maximum(T, 1)
        t = sit_down(self.c, self.ctx, len(self.contexts), parent[0], D, THETA, more)
        T = np.bincount(self.ctx, t, len(self.contexts))
        if totals is not None and is_heavy.any():
            still = totals[at[is_heavy], 2] == totals[at[is_heavy], 1]  # only the first seating is known: the others' tables grew as ours
            beyond[is_heavy] = np.where(still, T[is_heavy] * (more[is_heavy] - 1), beyond[is_heavy])
        rng, many = np.random.default_rng(seed), np.flatnonzero(self.c > 1)
        cm, xm = self.c[many], self.ctx[many]
        for s in range(samples):
            p = parent[s % len(parent)][many]
            for _ in range(GAP if s else BURN):
                now = draw_tables(rng, cm, t[many], p, (T + beyond)[xm], D, THETA)
                T += np.bincount(xm, now - t[many], len(T))
                t[many] = now
            yield t, (T + beyond)[self.ctx]

    def customers(self, place: Placement, totals: np.ndarray | None) -> np.ndarray:
        """Customers of each context, those in other buckets included."""
        n = np.bincount(self.ctx, self.c, len(self.contexts)).astype(float)
        is_heavy, at = place.heavy(self.contexts)
        if totals is not None and is_heavy.any():
            n[is_heavy] = totals[at[is_heavy], 0]
        return n


MESSAGE = "wb int, bucket int, w binary, t binary, c binary, heavy array<struct<i:int,c:long,t:long>>"
ROOT = "wb int, src array<int>, n array<int>, of binary, c binary, k binary, t array<binary>, n_train long, n_words long, n_customers long, tables array<double>"


def messages(kept: DataFrame, place: Placement, totals, replies: DataFrame | None) -> DataFrame:
    """What each bucket tells the root: for each of its words, tables in its restaurants and training count."""

    answered = replies is not None

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for row in b.to_pylist():
                x = Bucket(row["parts"])
                parent = _parent(x, row, place.word_buckets)[1] if answered else None
                for t, _ in x.seat(place, totals, parent, 1, seed=row["bucket"]):
                    pass
                order, cut = x.dealt(place.word_buckets)
                tw = np.bincount(x.word, t, len(x.words))[order].astype("<u4")
                cw = np.bincount(x.word, x.c, len(x.words))[order].astype("<u4")
                ws = x.words[order]
                is_heavy, at = place.heavy(x.contexts)
                cc, tt = np.bincount(x.ctx, x.c, len(x.contexts)), np.bincount(x.ctx, t, len(x.contexts))
                heavy = [{"i": int(at[i]), "c": int(cc[i]), "t": int(tt[i])} for i in np.flatnonzero(is_heavy)]
                full = np.flatnonzero(np.diff(cut))
                cols = [full.tolist(), [row["bucket"]] * len(full), *([f(v[cut[i] : cut[i + 1]]) for i in full] for f, v in ((six, ws), (np.ndarray.tobytes, tw), (np.ndarray.tobytes, cw))), [heavy] + [[]] * (len(full) - 1)]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("i", pa.int32()), ("c", pa.int64()), ("t", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["wb", "bucket", "w", "t", "c", "heavy"])

    return _with_replies(kept, replies).mapInArrow(run, MESSAGE)


def _with_replies(kept: DataFrame, replies: DataFrame | None) -> DataFrame:
    if replies is None:
        return kept.select("bucket", "parts")
    told = replies.groupBy("bucket").agg(F.collect_list(F.struct("wb", "c", "p")).alias("told"))
    return kept.join(told.hint("shuffle_hash"), "bucket").select("bucket", "parts", "told")


def _parent(x: Bucket, row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """By type: training count of its word, and the root's probability of it in each sample."""
    order, cut = x.dealt(buckets)
    c, p = np.zeros(len(x.words)), np.zeros((ROOT_SAMPLES, len(x.words)))
    for r in row["told"]:
        where = order[cut[r["wb"]] : cut[r["wb"] + 1]]
        c[where] = np.frombuffer(r["c"], "<u4")
        p[:, where] = np.frombuffer(r["p"], "<f4").reshape(ROOT_SAMPLES, -1)
    return c[x.word], p[:, x.word]


def root_states(told: DataFrame, buckets: int) -> DataFrame:
    """Root seating of each word bucket, sampled; rows keep who asked for which word."""

    def seated(wb: int, rows: list[tuple]) -> tuple:
        ws = [unsix(r[2]) for r in rows]
        words, inverse = np.unique(np.concatenate(ws), return_inverse=True)
        k = np.bincount(inverse, np.concatenate([np.frombuffer(r[3], "<u4") for r in rows]), len(words)).astype(np.int64)
        c = np.bincount(inverse, np.concatenate([np.frombuffer(r[4], "<u4") for r in rows]), len(words)).astype(np.int64)
        t, many, rng = np.minimum(k, 1), np.flatnonzero(k > 1), np.random.default_rng(wb)
        known = int((c > 0).sum())
        base, samples = 1.0 / (known * buckets + 1), []
        if len(k):
            t = sit_down(k, np.zeros(len(k), np.int64), 1, base, ROOT_D, ROOT_THETA, float(buckets))
        for s in range(ROOT_SAMPLES):
            for _ in range(GAP if s else BURN):
                t[many] = draw_tables(rng, k[many], t[many], base, np.full(len(many), float(t.sum()) * buckets), ROOT_D, ROOT_THETA)
            samples.append(t.astype("<u4").tobytes())
        sums = [float(np.frombuffer(x, "<u4").sum()) for x in samples]
        return wb, [r[1] for r in rows], [len(x) for x in ws], inverse.astype("<u4").tobytes(), c.astype("<u4").tobytes(), k.astype("<u4").tobytes(), samples, int(c.sum()), known, int(k.sum()), sums

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        names = [f.split()[0] for f in ROOT.split(", ")]
        send = lambda row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
        rows: list[tuple] = []
        for b in arrow:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and row[0] != rows[0][0]:
                    yield send(seated(rows[0][0], rows))
                    rows = []
                rows.append(row)
        if rows:
            yield send(seated(rows[0][0], rows))

    return told.select("wb", "bucket", "w", "t", "c").repartition(buckets, "wb").sortWithinPartitions("wb", "bucket").mapInArrow(run, ROOT)


def replies_of(roots: DataFrame, n_words: int, n_customers: int, tables: list[float]) -> DataFrame:
    """(bucket, wb, c, p): the root's answers, in the order of each bucket's words."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for row in b.to_pylist():
                c, k = np.frombuffer(row["c"], "<u4"), np.frombuffer(row["k"], "<u4")
                p = np.stack([(np.maximum(k - ROOT_D * np.frombuffer(t, "<u4"), 0) + (ROOT_THETA + ROOT_D * total) / (n_words + 1)) / (ROOT_THETA + n_customers) for t, total in zip(row["t"], tables, strict=True)])
                of = np.split(np.frombuffer(row["of"], "<u4"), np.cumsum(row["n"])[:-1])
                cols = [row["src"], [row["wb"]] * len(of), [c[x].tobytes() for x in of], [p[:, x].astype("<f4").tobytes() for x in of]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "wb", "c", "p"])

    return roots.mapInArrow(run, "bucket int, wb int, c binary, p binary")


def partial_scores(kept: DataFrame, place: Placement, totals, replies: DataFrame, n_train: int, n_words: int) -> DataFrame:
    """(batch, at, score, base, known): by bucket and batch, sums over each text's tokens in the bucket."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for row in b.to_pylist():
                x = Bucket(row["parts"])
                c, parent = _parent(x, row, place.word_buckets)
                customers = x.customers(place, totals)[x.ctx]
                mean = np.zeros(len(x.c))
                for s, (t, T) in enumerate(x.seat(place, totals, parent, SAMPLES, seed=row["bucket"] + 1)):
                    mean += (np.maximum(x.c - D * t, 0) + (THETA + D * T) * parent[s % ROOT_SAMPLES]) / (THETA + customers)
                score = np.log10(mean / SAMPLES)
                base = np.log10((c + 1) / (n_train + n_words + 1))
                cols: list[list] = [[], [], [], [], []]
                for p, of, n, places in zip(row["parts"], x.of, x.n, x.at, strict=True):
                    kind = np.repeat(of, n)
                    docs, at = np.unique(places, return_inverse=True)
                    sums = (np.bincount(at, v[kind], len(docs)) for v in (score, base, c > 0))
                    for col, v in zip(cols, (p["batch"], docs.tobytes(), *(s.astype("<f8").tobytes() for s in sums)), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["batch", "at", "score", "base", "known"])

    return _with_replies(kept, replies).mapInArrow(run, "batch long, at binary, score binary, base binary, known binary")


#: perplexity: of the text, its end included.
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def gather(headers: DataFrame, partials: DataFrame, n_train: int) -> DataFrame:
    """Each text's sums over all buckets."""
    none = F.lit(None).cast("binary")
    rows = headers.select("batch", F.lit(0).alias("kind"), F.col("uu").alias("a"), F.col("un").alias("b"), F.col("w").alias("c"), none.alias("d"))
    rows = rows.unionByName(partials.select("batch", F.lit(1).alias("kind"), F.col("at").alias("a"), F.col("score").alias("b"), F.col("base").alias("c"), F.col("known").alias("d")))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(head, sums):
            ids = np.frombuffer(head[2], "<i8")
            marks, size = np.frombuffer(head[3], np.uint8), np.frombuffer(head[4], "<u4").astype(np.int64)
            cols = [pa.array(ids, mask=marks > 1), pa.array(marks % 2 == 1), pa.array(size), pa.array(sums[2].round().astype(np.int64)), pa.array(np.full(len(ids), n_train)), pa.array(sums[1]), pa.array(sums[0])]
            cols.append(pa.array(10.0 ** (-sums[0] / size)))
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCORED.split(", ")])

        head, sums = None, None
        for b in arrow:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if row[1] == 0:  # a batch's header stands before its sums
                    if head is not None:
                        yield send(head, sums)
                    head, sums = row, np.zeros((3, len(row[2]) // 8))
                else:
                    at = np.frombuffer(row[2], "<u2")
                    for i in range(3):
                        sums[i, at] += np.frombuffer(row[3 + i], "<f8")
        if head is not None:
            yield send(head, sums)

    n = int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "batch").sortWithinPartitions("batch", "kind").mapInArrow(run, SCORED)


def score(spark: SparkSession, docs: DataFrame, *, rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text) outside the held fold and score every row."""
    stash = Stash(spark, "pitman_yor")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, min(MOST_BUCKETS, math.ceil(size / bucket_bytes)))
    place = Placement(buckets, heavy_contexts(docs, buckets))
    table, path = f"loresmith_pitman_yor_{uuid.uuid4().hex}", f"{stash.root}/buckets"
    rows = batches_of(docs, place)
    parts = F.collect_list(F.struct("batch", "uu", "un", "w", "held", "n", "at"))
    rows.groupBy("bucket").agg(parts.alias("parts")).write.option("compression", "zstd").bucketBy(min(buckets, 10_000), "bucket").option("path", path).saveAsTable(table)
    try:
        free_shuffles(spark)
        kept = spark.table(table).where("bucket >= 0")
        headers = spark.table(table).where("bucket < 0").select(F.explode("parts").alias("h")).select("h.batch", "h.uu", "h.un", "h.w")
        # of each heavy context: customers, tables of the first seating, tables now
        replies, totals, old = None, None, []
        for _ in range(rounds):
            told = stash.put(messages(kept, place, totals, replies), "told")
            heavy = told.select(F.explode("heavy").alias("h")).groupBy("h.i").agg(F.sum("h.c").alias("c"), F.sum("h.t").alias("t")).collect()
            first, totals = totals, np.zeros((len(place.ids), 3))
            for r in heavy:
                totals[r["i"]] = r["c"], r["t"], r["t"]
            if first is not None:
                totals[:, 1] = first[:, 1]
            roots = stash.put(root_states(told, place.word_buckets), "roots")
            sums = roots.agg(F.sum("n_train"), F.sum("n_words"), F.sum("n_customers"), *(F.sum(F.col("tables")[i]) for i in range(ROOT_SAMPLES))).first()
            n_train, n_words, n_customers = (int(x or 0) for x in sums[:3])
            replies = stash.put(replies_of(roots, n_words, n_customers, [float(x or 0) for x in sums[3:]]), "replies")
            stash.drop(told, roots, *old)
            old = [replies]
            free_shuffles(spark)
        partials = stash.put(partial_scores(kept, place, totals, replies, n_train, n_words), "partials")
        stash.drop(*old)
        return stash.put(gather(headers, partials, n_train), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # its files lie in the shared folder, outside the warehouse
        stash.delete(path)


def op1_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_pitman_yor_scoring": op1_pitman_yor_scoring}
ORACLES: dict[str, str] = {}
