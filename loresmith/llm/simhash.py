"""SimHash near-duplicates found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments, each padded to the 23 bits of the perfect binary
Golay code. The codewords within four bits of a segment (one to six of them) are its fuzzy keys:
two segments that differ in at most one bit share a key. Of two errors in three segments, some
segment is free of errors while the next one, in a circle, has one at most; so a key is the exact
bits of a segment with a fuzzy key of the next, and a fingerprint has at most 18 keys. Fingerprints
that meet under a key are verified by their differing bits.

Two forms share this. By ``distance``: fingerprints of 64 bits link at up to two differing bits,
exactly. By ``similarity``: sketches of twice 64 bits are candidates at ``sketch_bits`` differing bits,
the mean for shingle sets of that Jaccard similarity and a margin; a key is then a fuzzy key of a
segment with a fuzzy key of another one of its half, or of the segment of its place in the other half. Of pairs at the
similarity itself more than nine in ten meet, of closer ones more. Candidates link only if their shingle sets have the similarity, counted out.

Equal fingerprints, or equal shingle sets, are one row before any of this. Under a key with more than ``BUCKET`` distinct
fingerprints no pairs are formed; those fingerprints are linked exactly by the 65 points within
one bit of each: two fingerprints differ in at most two bits if and only if they share such a
point, and all that share a point are linked by a star.

Defined cases: a null or word-free text has fingerprint zero, a repeated row or doc_id is one more
member of its fingerprint, a null doc_id is a member that never names a component unless all are
null, an empty table gives no rows, other columns are ignored.
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
from loresmith.llm.store import Stash

#: Generator polynomial of the (23, 12, 7) Golay code, a fixed value: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: (low bit, bits) of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Distinct fingerprints under one key up to which they are compared with each other.
BUCKET = 64
MAX_DISTANCE = 2
#: Shingle sets in a block of a doubtful component.
BLOCK = 256
#: Segments of both halves of a sketch whose fuzzy keys make a key together: those of a half, and those of one place in both.
PAIRS = tuple((i, j) for i, j in combinations(range(6), 2) if i // 3 == j // 3 or j - i == 3)
#: Margin in standard deviations over the mean number of differing bits at a similarity.
MARGIN = 2.5


def remainders(words: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the remainder by the generator polynomial."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@lru_cache(1)
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes the error patterns of up to four bits that give it.

    (2048, 6) patterns and how many there are: one if the lightest has at most two bits, else six.
    """
    from itertools import combinations

    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(remainders(errors).tolist(), errors.tolist(), strict=True):
            found[s].append(e)
    n = np.array([len(f) for f in found])
    table = np.zeros((2048, n.max()), np.int64)
    for s, f in enumerate(found):
        table[s, : len(f)] = f
    return table, n


def fuzzy_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the index of every codeword within four bits of each 23-bit segment."""
    table, n = patterns()
    s = remainders(segment)
    row = np.repeat(np.arange(len(segment)), n[s])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
    return row, (segment[row] ^ table[s[row], nth]) >> 11


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of unsigned fingerprints: segment number, its exact bits, a fuzzy key of the next."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, fuzzy = fuzzy_keys(parts[(i + 1) % 3])
        rows.append(row)
        keys.append((i << 40) | (parts[i][row] << 12) | fuzzy)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    h, ones = np.array(hashes, "<u8").view(np.uint8), np.zeros(64, np.int64)
    for at in range(0, len(h), 8 * 65536):
        ones += np.unpackbits(h[at : at + 8 * 65536].reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _spanning(a: np.ndarray, b: np.ndarray, up: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """A forest with the connectivity of the pairs; up: what earlier calls have connected, kept up to date."""
    up = {} if up is None else up

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _within_buckets(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links among the rows of each key (rows sorted by key), and rows of keys that hold too many."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    large = np.repeat(size > BUCKET, size)
    a, b, at = [], [], np.flatnonzero(np.repeat((size > 1) & (size <= BUCKET), size))
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= distance]
        a.append(near)
        b.append(near + step)
        step += 1
    links = []
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        links = _spanning(fp[a], fp[b])
    return links, np.unique(fp[large]).tolist()


def link_fingerprints(stash: Stash, distinct: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp`` that connect all within ``distance`` bits.

    Not every link: those kept connect the same fingerprints.
    """
    assert 0 <= distance <= MAX_DISTANCE

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            row, key = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            links, crowded = _within_buckets(key, fp, distance)
            a = [x for x, _ in links] + crowded
            b = [y for _, y in links] + [None] * len(crowded)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hot = None  # a key that has already been found crowded
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if hot is not None:
                same = k == hot
                if same.any():
                    yield pa.RecordBatch.from_arrays([pa.array(f[same]), pa.nulls(int(same.sum()), pa.int64())], names=["a", "b"])
                    k, f = k[~same], f[~same]
                    if not len(k):
                        continue
            key, fp = np.r_[key, k], np.r_[fp, f]
            if not len(key):
                continue
            tail = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if len(key) - tail > BUCKET:
                hot, tail = key[-1], len(key)
            yield send(key[:tail], fp[:tail])
            key, fp = key[tail:], fp[tail:]
        yield send(key, fp)

    met = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "key").sortWithinPartitions("key")
    met = stash.put(met.mapInArrow(meet, "a long, b long"), "met")
    flip = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(64)))
    crowded = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    points = crowded.select("fp", F.explode(flip).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    low = points.groupBy("point").agg(F.min("fp").alias("a"), F.array_distinct(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    stars = low.select("a", F.explode("all").alias("b"))  # 65 fingerprints at most share a point
    return met.where("b is not null").unionByName(stars if distance == 2 else _checked(stars, points, distance)).where("a != b").distinct()


def _checked(stars: DataFrame, points: DataFrame, distance: int) -> DataFrame:
    """For distances under two: points that are fingerprints themselves have their neighbours."""
    if distance == 0:
        return stars.limit(0)
    return points.where("fp != point").select(F.col("fp").alias("a"), F.col("point").alias("b")).join(
        points.select(F.col("fp").alias("b")).distinct(), "b", "left_semi"
    ).select("a", "b")


# --- by similarity


def sketch_bits(similarity: float) -> int:
    """Differing bits of 128 up to which sketches are candidates, for sets of that Jaccard similarity."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(128 * p + MARGIN * math.sqrt(128 * p * (1 - p)))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, of none has none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)} or {digest(b" ".join(words), 42)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def sketch(h: np.ndarray) -> tuple[int, int]:
    """Two unsigned 64-bit SimHashes of a shingle set; an even vote goes by the smallest hash."""
    if not len(h):
        return 0, 0
    again = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    again ^= again >> np.uint64(32)
    out = []
    for x in (h, again):
        bits, ones = x.view(np.uint8), np.zeros(64, np.int64)
        for at in range(0, len(bits), 8 * 65536):
            ones += np.unpackbits(bits[at : at + 8 * 65536].reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        tie = np.unpackbits(x[:1].view(np.uint8), bitorder="little").astype(bool)
        out.append(int.from_bytes(np.packbits((2 * ones > len(h)) | ((2 * ones == len(h)) & tie), bitorder="little").tobytes(), "little"))
    return out[0], out[1]


def set_id(h: np.ndarray) -> int:
    """A number for a shingle set."""
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), 7)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp, a, b): a number for the shingle set, and both halves of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t.as_py(), shingle) for t in batch.column(2))
            found = np.array([(set_id(h), *sketch(h)) for h in sets], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, i].copy()) for i in range(3))], names=["doc_id", "text_hash", "fp", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long, a long, b long")


def pair_keys(halves: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) for each of ``PAIRS``: the pair's number, and a fuzzy key of each segment."""
    fuzzy = [fuzzy_keys(((x >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for x in halves for low, bits in SEGMENTS]
    for number, (i, j) in enumerate(PAIRS):
        (r1, k1), (r2, k2) = fuzzy[i], fuzzy[j]
        n2 = np.bincount(r2, minlength=len(halves[0]))
        begin = np.cumsum(n2) - n2
        row = np.repeat(r1, n2[r1])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n2[r1]) - n2[r1], n2[r1])
        yield row, (number << 24) | (np.repeat(k1, n2[r1]) << 12) | k2[begin[row] + nth]


def _apart(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
    """Differing bits of the sketches numbered i and j."""
    return np.bitwise_count(a[i] ^ a[j]).astype(np.int16) + np.bitwise_count(b[i] ^ b[j])


def _reach(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Pairs that connect what is within ``bits`` bits: each found row is compared with those not found yet.

    Rows go from the one nearest to the bitwise majority of all, which among copies is nearest to their
    original, so that most pairs are of an original and a copy.
    """
    middle = [np.packbits(2 * _ones(x) > len(x), bitorder="little").view(np.uint64)[0] for x in (a, b)]
    far = np.bitwise_count(a ^ middle[0]).astype(np.int16) + np.bitwise_count(b ^ middle[1])
    left, x, y = np.argsort(far, kind="stable"), [], []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        nth = 0
        while nth < len(frontier) and len(left):
            i = frontier[nth]
            nth += 1
            near = _apart(a, b, left, i) <= bits
            if near.any():
                hit = left[near].tolist()
                x += [i] * len(hit)
                y += hit
                frontier += hit
                left = left[~near]
    return x, y


def _ones(x: np.ndarray) -> np.ndarray:
    """How many of the words have each bit."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(x), 65536):
        out += np.unpackbits(np.ascontiguousarray(x[at : at + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def candidates(distinct: DataFrame, bits: int) -> DataFrame:
    """Pairs (x, y), nearest first, that connect all shingle sets (fp, a, b) that meet under a key and are within ``bits`` bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                cols = [batch.column(i).slice(at, 2000).to_numpy() for i in range(batch.num_columns)]
                for row, key in pair_keys((cols[1].view(np.uint64), cols[2].view(np.uint64))):
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(pa.array(c[row]) for c in cols)], names=["key", "fp", "a", "b"])

    def pairs(key, fp, a, b) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(size > BUCKET):
            one = slice(start[i], start[i] + size[i])
            p, q = _reach(a[one], b[one], bits)
            x.append(start[i] + np.array(p, np.int64))
            y.append(start[i] + np.array(q, np.int64))
        at, step = np.flatnonzero(np.repeat((size > 1) & (size <= BUCKET), size)), 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            near = _apart(a, b, at, at + step) <= bits
            x.append(at[near])
            y.append(at[near] + step)
            step += 1
        x, y = np.concatenate(x), np.concatenate(y)
        order = np.argsort(_apart(a, b, x, y), kind="stable")
        links = _spanning(fp[x[order]], fp[y[order]])
        return pa.RecordBatch.from_arrays([pa.array([min(e) for e in links], pa.int64()), pa.array([max(e) for e in links], pa.int64())], names=["x", "y"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        rows = 0
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            cols[2], cols[3] = cols[2].view(np.uint64), cols[3].view(np.uint64)
            for h, c in zip(held, cols, strict=True):
                h.append(c)
            rows += batch.num_rows
            if rows < 50_000:
                continue
            whole = [np.concatenate(h) for h in held]
            tail = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
            if tail:
                yield pairs(*(w[:tail] for w in whole))
            held, rows = [[w[tail:]] for w in whole], 0
        if held[0]:
            yield pairs(*(np.concatenate(h) for h in held))

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = distinct.select("fp", "a", "b").mapInArrow(emit, "key int, fp long, a long, b long").repartition(n, "key").sortWithinPartitions("key")
    return met.mapInArrow(meet, "x long, y long").distinct()


def sets_of(stash: Stash, docs: DataFrame, distinct: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(fp, s): the shingle sets of both ends of ``pairs`` (x, y), from the texts."""
    ends = pairs.select(F.col("x").alias("fp")).unionByName(pairs.select(F.col("y").alias("fp"))).distinct()
    wanted = stash.put(distinct.join(ends, "fp").select("fp", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *held]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(h) for h in held])].astype(np.int32)), flat)
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), lists], names=["fp", "s"])

        fps, held, n = [], [], 0
        for batch in batches:
            for fp, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fps.append(fp)
                held.append(shingle_set(text.as_py(), shingle))
                n += len(held[-1])
                if n > 500_000:
                    yield send()
                    fps, held, n = [], [], 0
        yield send()

    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").alias("d").join(
        wanted.alias("w"), (F.xxhash64("d.text") == F.col("w._hash")) & F.col("d._d").eqNullSafe(F.col("w._id"))
    )
    held = texts.select("w.fp", "d.text").mapInArrow(sets, "fp long, s array<long>")
    return stash.put(held.groupBy("fp").agg(F.first("s").alias("s")), "sets")  # a repeated row brings its set again


def verified(stash: Stash, held: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (x, y) with ok: whether the shingle sets ``held`` (fp, s) have that Jaccard similarity."""
    both = pairs.join(held.select(F.col("fp").alias("x"), F.col("s").alias("sx")), "x").join(held.select(F.col("fp").alias("y"), F.col("s").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    return stash.put(both.select("x", "y", (shared >= similarity * (F.size("sx") + F.size("sy") - shared)).alias("ok")), "verified")


def _links_across(fp: np.ndarray, a: np.ndarray, b: np.ndarray, root: list, side: np.ndarray, sets: list[frozenset], bits: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is similar and not linked so far, among the rows of one or two blocks (sides 1 and 2)."""
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out, size = [], np.array([len(s) for s in sets])
    for i in range(len(fp)):
        apart = _apart(a, b, slice(i + 1, None), i)
        least, most = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        fit = np.flatnonzero((apart <= bits) & ((side[i] == 0) | (side[i + 1 :] != side[i])) & (least >= similarity * most))
        for j in (fit[np.argsort(apart[fit], kind="stable")] + i + 1).tolist():
            p, q = top(root[i]), top(root[j])
            if p == q:
                continue
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                up[p] = q
                out.append((int(fp[i]), int(fp[j])))
    return out


def links_within(stash: Stash, suspects: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Links (x, y) that connect, within each ``comp`` of ``suspects`` (fp, a, b, root, comp, s), what is similar and of different roots.

    Members of a component are dealt to blocks of about ``BLOCK``, and each pair of blocks is a group of
    its own: pairs are compared where they meet, and only links leave.
    """
    sizes = suspects.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = suspects.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).otherwise(1 + (F.col("block") == low).cast("int"))
    dealt = dealt.select("comp", low.alias("low"), high.alias("high"), "fp", "a", "b", "root", side.alias("side"), "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(rows: list[tuple]) -> pa.RecordBatch:
            fp, a, b, root, sides, sets = zip(*rows, strict=True) if rows else ([], [], [], [], [], [])
            u64 = lambda x: np.array(x, np.int64).view(np.uint64)
            links = _links_across(np.array(fp, np.int64), u64(a), u64(b), list(root), np.array(sides, np.int64), list(sets), bits, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "y"])

        now, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            cols = [batch.column(i).to_pylist() for i in range(3, 8)]
            for k, key in enumerate(keys):
                if key != now:
                    if held:
                        yield send(held)
                    now, held = key, []
                held.append((*(c[k] for c in cols), frozenset(batch.column(8)[k].as_py())))
        yield send(held)

    n = int(suspects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("comp", "low", "high")
    return stash.put(dealt.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(run, "x long, y long"), "across")


def link_sketches(stash: Stash, docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (x, y) among distinct shingle sets (fp, a, b, first) that connect all candidates of that similarity.

    Candidates are first connected by as few pairs as it takes, and those are verified. Only among
    candidates that a failed pair connects can a link be missing: there all members are compared
    across what is linked so far.
    """
    bits = sketch_bits(similarity)
    met = stash.put(candidates(distinct, bits), "met")
    held = sets_of(stash, docs, distinct, met, shingle)
    sure = verified(stash, held, met, similarity)
    links, failed = sure.where("ok").select("x", "y"), sure.where("not ok")
    if failed.isEmpty():
        return links
    near = stash.put(components(stash, met, "x", "y"), "near")
    doubtful = failed.join(near, F.col("x") == F.col("node")).select(F.col("root").alias("comp")).distinct()
    roots = stash.put(components(stash, links, "x", "y").withColumnRenamed("node", "fp"), "roots")
    suspects = near.select(F.col("node").alias("fp"), F.col("root").alias("comp")).join(doubtful, "comp", "left_semi")
    suspects = suspects.join(distinct.select("fp", "a", "b"), "fp").join(roots, "fp", "left").join(held, "fp").select("fp", "a", "b", F.coalesce("root", "fp").alias("root"), "comp", "s")
    # what is linked, as stars, and what joins them
    return roots.select(F.col("fp").alias("x"), F.col("root").alias("y")).where("x != y").unionByName(links_within(stash, suspects, bits, similarity))


def _grouped(stash: Stash, prints: DataFrame, distinct: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``prints`` with the first (least) member of their component."""
    roots = components(stash, links, a, b)
    named = distinct.select("fp", "first").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stash.put(named, "named")
    lowest = named.groupBy("root").agg(F.min("first").alias("least"))
    groups = named.join(lowest, "root").select("fp", "least")
    return prints.join(groups, "fp")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, similarity: float | None = 0.8, distance: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): documents grouped by chains of near copies.

    component_id is the smallest doc_id of the group. ``shingle``: words in a shingle. By default
    texts link at a Jaccard similarity of their shingle sets, and two columns follow: text_hash (of a
    row's text) and first, whether the row's doc_id and text are those of the group's first member
    (by doc_id, null last, then text_hash). With ``distance``, 64-bit fingerprints of all shingles, repeats
    included, link at up to so many bits (two at most).
    """
    stash = Stash(spark, "simhash")
    if distance is not None:
        prints = stash.put(fingerprints(docs, shingle), "prints")
        distinct = stash.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        return _grouped(stash, prints, distinct, link_fingerprints(stash, distinct, distance), "a", "b").select("doc_id", "fp", F.col("least").alias("component_id"))
    prints = stash.put(sketches(docs, shingle), "prints")
    member = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    distinct = stash.put(prints.groupBy("fp").agg(F.min(member).alias("first"), F.first("a").alias("a"), F.first("b").alias("b")), "distinct")
    found = _grouped(stash, prints, distinct, link_sketches(stash, docs, distinct, shingle, similarity), "x", "y")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return found.select("doc_id", "fp", F.col("least.doc_id").alias("component_id"), "text_hash", first.alias("first"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: three-word shingles, links at two bits."""
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, distance=MAX_DISTANCE)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLES: dict[str, str] = {}
