"""Every operator against a brute-force version, a round trip or held-out accuracy."""

import collections
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loresmith.llm import chat, embeddings, graph, licenses, packing, pieces, pitman_yor, quality, simhash, store, templates, webpages

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in graph.components(store.Stash(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in nodes}


# --- packing


def test_lower_bound_and_packing():
    rng = np.random.default_rng(0)
    for _ in range(60):
        cap = int(rng.integers(5, 40))
        lengths = rng.integers(1, cap + 1, rng.integers(1, 9))
        counts = np.bincount(lengths, minlength=cap + 1)
        bound = packing.lower_bound(counts, cap)
        bins, offsets, fills = packing.best_fit_decreasing(lengths, cap)
        best = next(k for k in range(1, len(lengths) + 1) if fits(sorted(lengths.tolist(), reverse=True), [cap] * k))
        assert bound <= best <= len(fills)
        for b in range(len(fills)):
            at = np.argsort(offsets[bins == b])
            assert offsets[bins == b][at].tolist() == np.r_[0, np.cumsum(lengths[bins == b][at])[:-1]].tolist() and fills[b] <= cap


def fits(items, rooms):
    if not items:
        return True
    for i in {r: i for i, r in enumerate(rooms)}.values():
        if rooms[i] >= items[0]:
            rooms[i] -= items[0]
            if fits(items[1:], rooms):
                return True
            rooms[i] += items[0]
    return False


def test_packing_exchanges_between_partitions(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6.2, 1, 4000).astype(int) + 1).tolist()
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    out = packing.pack(store.Stash(spark, "t"), spark.createDataFrame(rows, packing.PIECE), per_partition=150).toPandas()
    assert sorted(out["doc_id"]) == list(range(4000)) and out["certified_gap"].iloc[0] == 0
    assert out["sequence_id"].nunique() == packing.lower_bound(np.bincount(lengths, minlength=4097), 4096)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.r_[0, np.cumsum(s["length"])[:-1]].tolist() and s["length"].sum() <= 4096


def test_piece_ids_are_the_tokenizers(documents):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path(packing.VOCABULARY)
    t, own = Tokenizer.from_file(path), packing.WordIds(path)
    assert own.by_pieces
    odd = ["", "a¶b ¶ c", "a★b ★ c ☆", "X.Y. A, b., c,. É. ß, it's. THE. <|ENDOFTEXT|>. <|", "<|endoftext|> x<|startoftext|>y", "It's   I'M\n\tdon't 1234 日本語 é é ß İ", "  nb sp", "a\x00b \x1c \x85"]
    for text in [*list(documents.values())[:80], *odd]:
        assert np.frombuffer(own(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_word_ids_of_odd_texts(monkeypatch):
    """Marks that compose, white space beyond ASCII, special names, contractions, and the memory's two generations."""
    from tokenizers import Tokenizer

    path = packing.vocabulary_path(packing.VOCABULARY)
    odd = ["J\u030c h\u0331 T\u0308x", "a\u00a0b\u2003c", "x<|endoftext|>y <|EndOfText|> B", "it's IT'S x'sabc 'tis !!'s", "\u0130stanbul \u03a3\u03a3 stra\u00dfe", "12\u00b2\u0664", "</w> w>", "", "\t \n", "\u00c5ngstr\u00f6m, A\u030angstro\u0308m.", "\ufb01ne \u212a \u1e9e"]
    odd += [" ".join(odd), "word " * 3000]
    rng = random.Random(4)
    odd += ["".join(rng.choice("aB' .\u00e9\u0301\u00a07<|>\n\u4e2d") for _ in range(200)) for _ in range(60)]
    for kept in (10, 1_000_000):
        monkeypatch.setattr(packing, "REMEMBERED", kept)
        encode, plain = packing.WordIds(path), Tokenizer.from_file(path)
        assert encode.by_pieces
        for _ in range(2):
            for at in range(0, len(odd), 7):
                part = odd[at : at + 7]
                assert [np.frombuffer(x, "<u4").tolist() for x in encode.many(part)] == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]


def test_other_vocabularies_are_encoded_as_they_are(spark, documents, monkeypatch):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path("byte_bpe_50k.json")
    encode, plain = packing.WordIds(path), Tokenizer.from_file(path)
    texts = [t or "" for t in list(documents.values())[:40]]
    assert not encode.by_pieces and [np.frombuffer(x, "<u4").tolist() for x in encode.many(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_encoded_in_parts(documents, monkeypatch):
    encode = packing.WordIds(packing.vocabulary_path(packing.VOCABULARY))
    texts = pa.array([None, *documents.values(), "", "x" * 5000])
    whole = list(packing._stretches(encode, texts))
    monkeypatch.setattr(packing, "AT_ONCE", 300)
    assert list(packing._stretches(encode, texts)) == whole and len(whole) == len(texts)


# --- SimHash


def test_fuzzy_keys_reach_two_errors():
    words = np.arange(0, 1 << 23, 4099)
    row, key = simhash.fuzzy_keys(words)
    have = collections.defaultdict(set)
    for r, k in zip(row.tolist(), key.tolist(), strict=True):
        have[r].add(k)
    for bits in [(i,) for i in range(23)] + list(itertools.combinations(range(0, 23, 3), 2)):
        r2, k2 = simhash.fuzzy_keys(words ^ sum(1 << b for b in bits))
        met = {r for r, k in zip(r2.tolist(), k2.tolist(), strict=True) if k in have[r]}
        assert len(met) == len(words)


def brute_fingerprint(text, k):
    import xxhash

    words = [w for w in text.encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(prints, distance):
    """Smallest id reachable of {id: fingerprint}."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_simhash_query(spark, documents):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op2_simhash_near_dedup(spark, DIR).collect()}
    prints = {i: brute_fingerprint(t or "", 3) for i, t in documents.items()}
    want = groups_of(prints, 2)
    assert got == {i: (prints[i], want[i]) for i in documents}


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_of_crowded_keys(spark, bucket, monkeypatch):
    """A dense cloud of fingerprints, with and without the exact way for crowded keys."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randint(0, 63)
            prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints.values()], "fp long")
    stash = store.Stash(spark, "t")
    roots = {r["node"]: r["root"] for r in graph.components(stash, simhash.link_fingerprints(stash, df)).collect()}
    want = collections.defaultdict(set)
    for i, g in groups_of(prints, 2).items():
        want[g].add(signed(prints[i]))
    have = collections.defaultdict(set)
    for x in prints.values():
        have[roots.get(signed(x), signed(x))].add(signed(x))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


@pytest.mark.parametrize("bucket", [64, 4])
def test_similarity_form(spark, bucket, monkeypatch):
    """Near copies of known similarity among others: no link beyond the bits, and nearly all at the similarity."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], []
    for i in range(60):
        words = [word() for _ in range(300)]
        base.append(len(rows))
        rows.append(" ".join(words))
        for edits in (2, 4, 6):
            w = list(words)
            for at in rng.sample(range(300), edits):
                w[at] = word()
            rows.append(" ".join(w))
    rows += [rows[0], "", "one two"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, df).collect()}
    sets = [shingles(t) for t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 150 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    want = {i: i for i in range(len(rows))}  # smallest reachable by pairs of the similarity
    for _ in rows:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert all(want[i] == want[g] for i, g in got.items())


def test_candidates_at_the_threshold():
    """Share of separate pairs of a similarity just over the threshold that meet under a key and within the bits, at the shipped margin."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    ends = []
    while len(ends) < 400:
        words = [word() for _ in range(rng.choice([120, 200, 400]))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.014, 0.026)))):
            other[at] = word()
        x, y = (simhash.shingle_set(" ".join(w), 5) for w in (words, other))
        if 0.8 <= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) <= 0.82:
            ends.append((simhash.sketch(x), simhash.sketch(y)))

    def keys(side):
        out = [set() for _ in ends]
        for row, key in simhash.pair_keys(tuple(np.array([e[side][h] for e in ends], np.uint64) for h in (0, 1))):
            for r, k in zip(row.tolist(), key.tolist(), strict=True):
                out[r].add(k)
        return out

    near = [sum((p ^ q).bit_count() for p, q in zip(*e, strict=True)) <= simhash.sketch_bits(0.8) for e in ends]
    met = [bool(a & b) and n for a, b, n in zip(keys(0), keys(1), near, strict=True)]
    assert sum(met) >= 0.93 * len(ends)


@pytest.mark.parametrize("block", [256, 4])
def test_similar_below_the_threshold_stay_apart(spark, block, monkeypatch):
    """Families whose members are near the threshold: a group is never joined by a pair below it."""
    monkeypatch.setattr(simhash, "MARGIN", 6.0)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(25):
        words = [word() for _ in range(200)]
        for edits in (0, 3, 5, 7, 9, 11):
            w = list(words)
            for at in rng.sample(range(200), edits):
                w[at] = word()
            rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, df).collect()}
    sets = [shingles(t) for t in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if alike(a, b) >= 0.8]
    want = {i: i for i in range(len(rows))}
    for _ in rows:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert len(set(want.values())) > 40 and all(want[i] == want[g] for i, g in got.items())
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)


# --- quality


def test_counts(spark, documents):
    got = {r["doc_id"]: r for r in quality.op3_quality_outliers(spark, DIR).collect()}
    for i, text in documents.items():
        words = text.split()
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if x.strip()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        )
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r["kept"] and r["base_failed"])


def test_outliers_by_labels(spark):
    """Held against the labels of the table: junk goes, clean texts stay."""
    d = "/root/testdata/sf0.01"
    j = quality.op3_quality_outliers(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    by = {(r["quality"], r["kept"]): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.02 * by[1, True] and by.get((0, True), 0) <= 0.05 * by[0, False]


def test_concentration_ignores_outliers(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (900, 6)), rng.normal(9, 0.3, (100, 6))]
    df = spark.createDataFrame([(i, i, "en", "a", *[0] * 5, *map(float, r)) for i, r in enumerate(x)], quality.STATS)
    m = {(r["k1"], r["k2"]): r for r in quality.estimates(store.Stash(spark, "t"), df).collect()}
    assert len(m) == 3 and np.abs(np.array(m["1en", "1a"]["mu"])).max() < 0.3


def brute_quality(groups):
    """Plain concentration on whole groups, {key: rows}: the same method without bins."""
    out = {}
    ridge = np.diag(quality.FLOOR**2)
    for key, x in groups.items():
        q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        best = None
        for spread in (((q[2] - q[0]) / 1.349) ** 2 + quality.FLOOR**2, quality.FLOOR**2):
            mu, inv, last = q[1], np.diag(1 / spread), np.inf
            for _ in range(100):
                d = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
                near = x[np.argsort(d, kind="stable")[: math.ceil(quality.SHARE * len(x))]]
                mu, cov = near.mean(axis=0), np.cov(near.T, bias=True) + ridge
                inv, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
                if last - det < 1e-9:
                    break
                last = det
            if best is None or det < best[0]:
                best = det, mu, inv
        _, mu, inv = best
        d = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
        near = x[d <= quality.chi_squared(quality.REWEIGHTED) * np.median(d) / quality.chi_squared(0.5)]
        mu, inv = near.mean(axis=0), np.linalg.inv(np.cov(near.T, bias=True) + ridge)
        d = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
        middle, upper = np.quantile(d, [0.5, 0.75])
        power = min(1.0, math.log(quality.chi_squared(0.25) / quality.chi_squared(0.5)) / math.log(upper / middle))
        out[key] = quality.chi_squared(0.5) * (d / middle) ** power
    return out


def test_distances_against_plain_estimates(spark):
    """The whole query: every row's distance and verdict are those of concentration without bins, but for rounding at the cutoff."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stats = quality.measure(docs).toPandas()
    x = stats[[f"x{i}" for i in range(quality.P)]].to_numpy()
    by = stats.groupby(["lang", "source"], dropna=False).indices
    langs = stats.groupby("lang", dropna=False).indices
    groups, of = {}, {}
    for (lang, source), at in by.items():
        key = (lang, source) if len(at) >= quality.LEAST_ROWS else lang if len(langs[lang]) >= quality.LEAST_ROWS else ""
        groups[key] = x[by[key]] if isinstance(key, tuple) else x[langs[key]] if key else x
        of[lang, source] = key
    places = {k: by[k] if isinstance(k, tuple) else langs[k] if k else np.arange(len(x)) for k in groups}
    found = brute_quality(groups)
    want = {}
    for pair, at in by.items():
        where = {int(p): i for i, p in enumerate(places[of[pair]])}
        want.update((int(stats["doc_id"].iloc[p]), float(found[of[pair]][where[int(p)]])) for p in at)
    got = {r["doc_id"]: r for r in quality.op3_quality_outliers(spark, d).collect()}
    ratio = np.array([math.log((got[i]["distance"] + 1) / (want[i] + 1)) for i in want])
    assert len(got) == len(want) and np.quantile(np.abs(ratio), 0.95) < 0.25
    cut = quality.chi_squared(quality.LEVEL)
    unlike = [i for i, w in want.items() if not got[i]["base_failed"] and got[i]["kept"] != (w <= cut)]
    assert len(unlike) <= 0.01 * len(want) and all(0.6 * cut < want[i] < 1.6 * cut for i in unlike)


# --- licenses


def test_license_scan(spark, documents):
    got = {r["doc_id"]: r for r in licenses.scan(spark, spark.read.parquet(f"{DIR}/documents.parquet")).collect()}
    named = 0
    for i, text in documents.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")
        words = [w for w in words if w]
        places = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        blocks = {(b["template"], b["first"], b["words"], round(b["containment"], 9)) for b in r["blocks"]}
        brute = set()
        raw = [w.encode() for w in words]
        for k, (_, t, names) in enumerate(licenses.TEMPLATES):
            own, runs = licenses.words_of(t), []
            want, span = set(own), math.ceil(licenses.SLACK * len(own))
            for end in range(len(raw)):
                window = raw[max(0, end + 1 - span) : end + 1]
                share = len(want.intersection(window)) / len(want)
                if raw[end] in want and share >= licenses.THRESHOLD - 1e-9 and set(licenses.words_of(names)) <= set(window):
                    begin = end + 1 - len(window) + next(j for j, w in enumerate(window) if w in want)
                    if runs and begin < runs[-1][1]:
                        runs[-1] = (runs[-1][0], end + 1, max(runs[-1][2], share))
                    else:
                        runs.append((begin, end + 1, share))
            brute |= {(k, x, y - x, round(c, 9)) for x, y, c in runs}
        assert blocks == brute
        named += bool(r["labels"])
    assert named > 3


def labels_of(spark, *texts):
    rows = licenses.scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["labels"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_license_labels_of_plain_notices(spark):
    assert labels_of(
        spark, "Released under the Apache License", "Licensed under CC BY 4.0", "licensed under the GNU General Public License", "licensed under the GNU Lesser General Public License, version 3",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0. All rights reserved.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "all the rights of the reserved seats", "Released under the Apache Foundation", None,
    ) == ["apache", "cc-by", "gpl", "gpl,lgpl", "cc-by-nc", "all-rights-reserved,cc-by-nc-sa", "cc-by-sa", "", "", ""]


def test_license_blocks_wrap_and_stand_beside_others(spark):
    grant = next(t for label, t, _ in licenses.TEMPLATES if label == "mit" and "sublicense" in t)
    wrapped = "\n".join(["x y z"] * 50 + grant.split() + ["x y z"] * 50)  # one word a line
    missing = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these are met. All rights reserved."
    assert labels_of(spark, wrapped, missing) == ["mit", "all-rights-reserved,bsd"]


def test_license_scan_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = c.sql(licenses.ORACLES["op4_license_set_join"])
    got = licenses.op4_license_set_join(spark, DIR)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


# --- line dedup


def test_lines_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = sorted(map(tuple, c.sql(templates.ORACLES["op5_log_template_lines"]).fetchall()))
    assert sorted(tuple(r) for r in templates.op5_log_template_lines(spark, DIR).collect()) == want


def test_templates_generalise(spark):
    rows = [
        (1, "user 17 logged in from host 4 at noon today\nown line of the first one"), (2, "user 99 logged in from host 7 at noon today\nanother thing"),
        (3, "the same first words and then a long tail of text ends here\nz"), (4, "the same first words and then a long tail of text stops there\ny"),
        (5, "short"), (6, "short"),
        (7, "user alice logged in from host bravo near the gate today"), (8, "user carol logged in from host delta near the gate tonight"),
        (9, "user alice logged off at noon bravo while some rain fell outside"),
    ]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("another thing", 1), 3: (rows[2][1], 0), 4: ("y", 1), 5: ("short", 0), 6: ("short", 0), 7: (rows[6][1], 0), 8: ("", 1), 9: (rows[8][1], 0)}
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("another thing", 1), 3: (rows[2][1], 0), 4: ("y", 1), 5: ("short", 0), 7: (rows[6][1], 0), 8: (rows[7][1], 0), 9: (rows[8][1], 0)}


def test_tables_of_other_numbers_stay(spark):
    """Documents go by equal lines alone: not for lines that differ in their numbers."""
    table = lambda k: "\n".join(f"Row {i} has the value {k * i + 7} and the share {k} % of all" for i in range(8))
    rows = [(1, table(3)), (2, table(5)), (3, table(3)), (4, table(3) + "\n\n" + table(5)), (5, table(5) + "\nand one more line that no other document has at all"), (6, None), (7, " \n"), (1, table(3))]
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect() if r["text"])
    assert got == [(1, table(3)), (1, table(3)), (2, table(5)), (5, "and one more line that no other document has at all"), (7, " \n")]


# --- chat


def test_known_roles_and_their_rows_stand(spark):
    """A row with a role is one turn of that role, word for word; one without is cut at its markers; a raw one always."""
    rows = [
        (1, 0, "user", "My setup is\nSystem: Linux\nModel: X200\nwhy does it fail?"), (1, 1, "assistant", "Try this.\nAnswer: 42"), (1, 2, "user", "User: hm\n\nA: b"), (1, 3, "assistant", "Q: so?"),
        (2, 0, None, "User: hello\nthere\nAssistant: hi"), (2, 1, "assistant", "x"), (3, 0, "assistant", "a"), (3, 1, "assistant", "b"), (3, 2, "system", "Human: c"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"], r["part"], r["role"], r["text"]) for r in chat.format_conversations(spark, df).collect())
    want = [(c, t, 0, role, text.strip()) for c, t, role, text in rows if role] + [(2, 0, 0, "user", "hello\nthere"), (2, 0, 1, "assistant", "hi")]
    assert got == sorted(want)
    long = [(1, 0, "user", "long\nUser: " * 3000), (1, 1, "assistant", "b")]
    got = chat.format_conversations(spark, spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["role"], r["text"]) for r in got) == sorted((role, text.strip()) for _, _, role, text in long)
    raw = chat.parse_transcripts(spark.createDataFrame([(1, "User: a\nAssistant: b\nmore")], "conv_id long, text string"), chat.fit(df))
    assert [(r["role"], r["text"]) for r in raw.orderBy("part").collect()] == [("user", "a"), ("assistant", "b\nmore")]


def test_roles_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = chat.op6_transcript_roles(spark, d)
    truth = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("truth"))
    rows = got.join(truth, ["conv_id", "turn"]).select("role", "truth").collect()
    assert len(rows) == truth.count() and all(r["role"] == r["truth"] for r in rows)
    found = chat.held_out_roles(spark.read.parquet(f"{d}/conversations.parquet")).collect()
    assert sum(r["n"] for r in found if r["truth"] == r["role"]) > 0.95 * sum(r["n"] for r in found) > 50


def random_hmm(rng):
    return chat.Hmm([(b, r, on, rng.randint(0, 15), rng.randint(0, 1), rng.randint(1, 9)) for b in (-1, 0, 1, 2) for r in range(3) for on in (0, 1) for _ in range(4)])


def best_path(h, shown):
    """Over all paths."""
    total = lambda z: h.start[z[0]] + sum(s[r] for s, r in zip(shown, z, strict=True)) + sum(h.move[a][b] for a, b in itertools.pairwise(z))
    return list(max(itertools.product(h.states, repeat=len(shown)), key=total))


def test_viterbi_is_exact():
    rng = random.Random(1)
    h = random_hmm(rng)
    for _ in range(60):
        shown = [[rng.uniform(-3, 0) for _ in h.states] for _ in range(rng.randint(1, 6))]
        p, got = chat.Path(h), []
        for s in shown:
            got += p.step(s)
        assert got + p.end() == best_path(h, shown)
    # long sequences are decided on the way, as by plain Viterbi
    shown = [[rng.uniform(-3, 0) for _ in h.states] for _ in range(3000)]
    p, got, most = chat.Path(h), [], 0
    for s in shown:
        got += p.step(s)
        most = max(most, len(p.back))
    got += p.end()
    score, back = [h.start[s] + shown[0][s] for s in h.states], []
    for x in shown[1:]:
        back.append([max(h.states, key=lambda q: score[q] + h.move[q][s]) for s in h.states])  # noqa: B023
        score = [score[back[-1][s]] + h.move[back[-1][s]][s] + x[s] for s in h.states]
    want = [max(h.states, key=lambda s: score[s])]
    for k in back[::-1]:
        want.append(k[want[-1]])
    assert got == want[::-1] and most < 300


def test_turns_against_all_paths(spark):
    """The whole query: every conversation's turns are those of the best of all state paths of its lines."""
    rng = random.Random(6)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 3)):
            lines = [rng.choice(["", "User: ", "Bot: ", ""]) + "x" * rng.randint(0, 60) + rng.choice(["", "?"]) for _ in range(rng.randint(1, 2))]
            rows.append((conv, turn, rng.choice([None, "user", "assistant", "zzz", "System"]), "\n".join(lines)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    h = chat.fit(df)
    got = collections.defaultdict(list)
    for r in chat.tag(chat.observed(df), h).orderBy("conv_id", "turn", "part").collect():
        got[r["conv_id"]].append((r["turn"], r["part"], r["role"], r["text"]))
    for conv, mine in itertools.groupby(rows, key=lambda r: r[0]):
        lines = [(t, x) for _, t, role, text in mine for x in chat.lines_of(text, chat.role_of(role))]
        want = []
        for (t, x), s in zip(lines, best_path(h, [h.shown(x) for _, x in lines]), strict=True):
            if s % 2 == 0:
                want.append([t, sum(w[0] == t for w in want), chat.ROLES[s // 2], x.body])
            else:
                want[-1][3] += "\n" + x.body
        assert got[conv] == [(t, p, r, text.strip()) for t, p, r, text in want]


def test_raw_transcripts(spark):
    h = chat.fit(spark.read.parquet(f"{DIR}/conversations.parquet"))
    rows = [
        (1, "System: be kind\nUser: hi?\n**Assistant:** hello\nQ: why?\nA: because"),
        (2, "User: first line\nsecond line of the same user\n\nAssistant: reply\nmore reply"),
        (None, "Human: one\nAI: two"),
    ]
    got = collections.defaultdict(list)
    for r in chat.parse_transcripts(spark.createDataFrame(rows, "conv_id long, text string"), h).orderBy("conv_id", "part").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got[1] == [("system", "be kind"), ("user", "hi?"), ("assistant", "hello"), ("user", "why?"), ("assistant", "because")]
    assert got[2] == [("user", "first line\nsecond line of the same user"), ("assistant", "reply\nmore reply")]
    assert got[None] == [("user", "one"), ("assistant", "two")]


# --- embeddings


@pytest.mark.parametrize("aside", [0.0, 1.5])
def test_recall(spark, aside):
    """Clusters that straddle the threshold, around the origin and far to one side of it."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64)) + aside
    x = np.concatenate([c + rng.normal(size=(12, 64)) * s for c, s in zip(centres, np.linspace(0.05, 0.35, 40), strict=True)]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark, df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = ((y @ y.T) >= 0.93) & (label[:, None] == label[None, :])
    want = links.sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum() > 0


def test_codes_within_reach_meet_once():
    """By brute force: every pair of codes within the reach meets, and counts at one table and point."""
    bits, tables, radius, reach = embeddings.plan(1000)
    assert (bits, (2 * radius + 1) * tables - 1) == (16, reach)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << bits, (12, tables))
    subs = np.concatenate([base ^ np.where(rng.random((12, tables)) < p, rng.integers(0, 1 << bits, (12, tables)) & rng.integers(0, 1 << bits, (12, tables)) & rng.integers(0, 1 << bits, (12, tables)), 0) for p in (0, 0.5, 1)])
    subs = np.concatenate([subs, subs[:5]])
    flips = embeddings.ball(bits, radius)
    met = collections.defaultdict(list)
    for r, row in enumerate(subs):
        for t in range(tables):
            for p in row[t] ^ flips:
                met[t, int(p)].append(r)
    seen = collections.Counter()
    for (t, p), rows in met.items():
        pairs = list(itertools.combinations(rows, 2))
        if pairs:
            i, j = np.array(pairs).T
            table, point = np.full(len(subs), t), np.full(len(subs), p)
            seen.update(pairs[k] for k in embeddings._once(i, j, table, point, subs, bits, radius, reach))
    apart = np.bitwise_count(subs[:, None] ^ subs[None]).sum(axis=2)
    assert set(seen.values()) == {1} and set(seen) == {(i, j) for i, j in itertools.combinations(range(len(subs)), 2) if apart[i, j] <= reach}


def test_links_of_large_components_and_mixed_lengths(spark):
    big = 1e300
    rows = [(0, [big, big, 0.0]), (1, [big, big * 0.99, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [1e-300, 0.0]), (5, [1.0] * 5000), (6, [1.0] * 4999 + [1.1])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark, spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_blocks_of_a_crowded_key(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(6)
    x = (np.ones(16) + rng.normal(size=(60, 16)) * 0.02).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    assert {(r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark, df).collect()} == {(59, 0)}


# --- pieces


def test_parity_and_round_trip(spark, documents):
    got = pieces.op8_sentencepiece_codec(spark, DIR)
    assert got.where("not parity or not round_trip").count() == 0 and got.count() == len(documents)
    own, other = pieces.codec(packing.vocabulary_path(pieces.MODEL))
    odd = ["", " ", "  a  b ", "\n\nx\t y", "日本語 😀", "▁x", "a\x00b", "x" * 3000, " " * 41 + "z", "a  " * 50, "é é ﻿"]
    ids = own.encode(odd)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == other.encode(odd)
    assert [own.decode(i) for i in ids] == [t.replace("▁", " ") for t in odd]
    whole = own.tokenizer
    for t in odd[:8]:
        assert whole.encode(t).ids == other.encode(t)


def test_decode_frame(spark):
    e = pieces.encode(spark.createDataFrame([(1, "hello  world\n"), (2, None)], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in pieces.decode(e).collect()} == {1: "hello  world\n", 2: ""}


def test_unigram_model():
    def field(n, kind, value):
        return bytes([n << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)

    import struct

    pieces_raw = b""
    for p, s, k in [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("▁ab", -1.0, 1), ("ab", -2.5, 1)]:
        m = field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))
        pieces_raw += field(1, 2, m)
    raw = pieces_raw + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    c = pieces.Codec(raw)
    assert c.model.kind == pieces.UNIGRAM
    assert [np.frombuffer(i, "<u4").tolist() for i in c.encode(["ab ab", "abab"])] == [[4, 4], [4, 5]]


# --- pages


def test_pages_keep_articles(spark):
    import html
    import re

    for r in webpages.op10_html_page_differencing(spark, DIR).join(spark.read.parquet(f"{DIR}/pages.parquet"), ["page_id", "url"]).collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<(?!/?(p|h1)\b)[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in want if x)


def test_differencing(spark):
    page = "<body><div>Site name</div><div>Own text {0} &amp; more</div><div>All about us</div><aside>x</aside><div class='comment-list'>no</div></body>"
    rows = [(i, f"http://h.org/a/{i}", page.format(i)) for i in range(4)] + [(9, "http://other.org/a/1", "<div>Site name</div>")]
    got = {r["page_id"]: r["text"] for r in webpages.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {**{i: f"Own text {i} & more" for i in range(4)}, 9: "Site name"}


def test_differencing_beside_articles():
    """A page with an article loses what its neighbours share outside it, and nothing else."""
    page = "<div>Site name</div><article class=teaser>Teaser</article><div>Body {0}</div><div>All about us</div><nav>Menu</nav>"
    a, b = (webpages.blocks_of(page.format(i)) for i in "ab")
    assert webpages.main_text(a, [b]) == ("Teaser\nBody a", 4, 2)
    assert webpages.main_text(a, []) == ("Site name\nTeaser\nBody a\nAll about us", 0, 0)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='content with-sidebar'><article><h1>T</h1><p>body</p></article><div class=sidebar>side</div></div>", "T\nbody"),
        ("<article><h1>T</h1><section id='discussion'><h2>Discussion</h2><p>we found</p></section></article>", "T\nDiscussion\nwe found"),
        ("<article><p class='notice'>Mind the gap</p><p>body</p></article>", "Mind the gap\nbody"),
        ("<article><div class='article-header'><h1>T</h1></div><p>body</p></article>", "T\nbody"),
        ("<main><div class='post'>body</div><div class='tags'><a href=x>one</a> <a href=y>two</a></div><div class='comments'>me too</div></main>", "body"),
        ("<article>body</article><div class='related'><article>teaser</article></div><div class='ad'>Buy</div>", "body"),
        ("<div id='page-header'><main>body <b class='alert'>now</b></main></div>", "body\nnow"),
        ("<body class='sidebar'><p>all</p></body>", "all"),
        ("<div class='promo'><p>buy</p><span>x</span></div><p>rest</p>", "rest"),
        ("<article><p>a</p><aside>b</aside><nav>c</nav><footer>d</footer><div hidden>e</div></article>", "a"),
    ],
)
def test_class_words_never_delete_an_article(page, text):
    assert webpages.main_text(webpages.blocks_of(page), [])[0] == text


def test_doubtful_lines_go_by_differencing():
    """A class word within an article deletes what a neighbour repeats, and what it does not stays."""
    page = "<article><p class='notice'>{0}</p><p>Same words</p><p>Body {1}</p></article>"
    a, b, c = (webpages.blocks_of(page.format(*x)) for x in (("Sign up", "a"), ("Sign up", "b"), ("Wet paint", "c")))
    assert webpages.main_text(a, [b]) == ("Same words\nBody a", 2, 1)
    assert webpages.main_text(c, [b]) == ("Wet paint\nSame words\nBody c", 1, 0)


def test_pages_are_compared(spark):
    """Furniture that carries no telling mark goes by differencing alone, on every page with a neighbour."""
    rng = random.Random(7)
    rows, want = [], {}
    for h in range(6):
        lines = [f"Template {h} {k}" for k in range(8)]
        for k in range(rng.randint(2, 9)):
            own = [f"Own {h} {k} {j}" for j in range(rng.randint(0, 5))]
            mixed, left = [], list(own)
            for x in lines:
                while left and rng.random() < 0.4:
                    mixed.append(left.pop(0))
                mixed.append(x)
            mixed += left
            want[len(rows)] = "\n".join(own)
            rows.append((len(rows), f"http://h{h}.org/{rng.choice('abc')}/{k:03}", "".join(f"<div>{x}</div>" for x in mixed)))
    got = {r["page_id"]: r for r in webpages.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_near"] >= 1 and r["n_shared"] == 8 for r in got.values())


@pytest.mark.parametrize("bits", [200_000_000, 40])
def test_alignment_of_many_lines(bits, monkeypatch):
    """Against the textbook table, whole and halved."""
    monkeypatch.setattr(webpages, "ALIGNED_BITS", bits)
    rng = random.Random(5)
    for _ in range(40):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 60))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = webpages._aligned(a, b)
        assert got == sorted(set(got)) and len(got) == table[-1][-1] and subsequence([a[i] for i in got], b)


def test_common_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        got = webpages.common(a, b)
        longest = max(k for k in range(len(a) + 1) for c in itertools.combinations(a, k) if subsequence(c, b))
        assert len(got) == longest and subsequence([a[i] for i in sorted(got)], b)


def subsequence(c, b):
    it = iter(b)
    return all(x in it for x in c)


# --- language model


@pytest.mark.parametrize("bucket_bytes", [6_000_000, 40_000])
def test_scores(spark, documents, bucket_bytes):
    got = {r["doc_id"]: r for r in pitman_yor.score(spark, spark.read.parquet(f"{DIR}/documents.parquet"), bucket_bytes=bucket_bytes).collect()}
    count = collections.Counter()
    tokens = {i: [*t.encode().lower().split(), None] for i, t in documents.items()}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(count[x] > 0 for x in t))
        assert abs(r["base_score"] - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) < 1e-6 * len(t)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_scores(tokens, sweeps=14, burn=6):
    """A textbook sampler, customer by customer at tables of their own: log10 probability of every text."""
    rng = random.Random(11)
    train = [(u, w) for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for u, w in itertools.pairwise([0, *t])]
    base = 1 / (len({w for _, w in train}) + 1)

    class Restaurant:
        def __init__(self, d, theta):
            self.d, self.theta, self.at, self.n, self.t = d, theta, {}, 0, 0

        def p(self, w, parent):
            at = self.at.get(w, ())
            return (max(sum(at) - self.d * len(at), 0) + (self.theta + self.d * self.t) * parent) / (self.theta + self.n)

        def sit(self, w, parent):
            at = self.at.setdefault(w, [])
            x = rng.random() * (sum(at) - self.d * len(at) + (self.theta + self.d * self.t) * parent)
            self.n += 1
            for k, c in enumerate(at):
                x -= c - self.d
                if x < 0:
                    at[k] += 1
                    return False
            at.append(1)
            self.t += 1
            return True

        def leave(self, w):
            at = self.at[w]
            k = rng.choices(range(len(at)), at)[0]
            at[k] -= 1
            self.n -= 1
            if at[k]:
                return False
            del at[k]
            self.t -= 1
            return True

    root, rest = Restaurant(pitman_yor.ROOT_D, pitman_yor.ROOT_THETA), collections.defaultdict(lambda: Restaurant(pitman_yor.D, pitman_yor.THETA))
    total, samples = collections.Counter(), 0
    texts = {i: list(itertools.pairwise([0, *t])) for i, t in tokens.items()}
    pairs = {x for t in texts.values() for x in t}
    for sweep in range(sweeps):
        for u, w in train:
            if sweep and rest[u].leave(w):
                root.leave(w)
            if rest[u].sit(w, root.p(w, base)):
                root.sit(w, base)
        if sweep >= burn:
            samples += 1
            for u, w in pairs:
                total[u, w] += rest[u].p(w, root.p(w, base)) if u in rest else root.p(w, base)
    return {i: sum(math.log10(total[x] / samples) for x in t) for i, t in texts.items()}


def test_scores_are_those_of_a_plain_sampler(spark, documents):
    """Every text's score against customer-by-customer Gibbs sampling in one process."""
    got = {r["doc_id"]: r for r in pitman_yor.score(spark, spark.read.parquet(f"{DIR}/documents.parquet"), bucket_bytes=100_000).collect()}
    numbers: dict = {}
    tokens = {i: [numbers.setdefault(w, len(numbers) + 2) for w in t.encode().lower().split()] + [1] for i, t in documents.items()}
    want = plain_scores(tokens)
    for held in (False, True):
        ids = [i for i, r in got.items() if r["held_out"] == held]
        assert abs(sum(got[i]["score"] for i in ids) / sum(want[i] for i in ids) - 1) < 0.01
    n = {i: len(t) for i, t in tokens.items()}
    assert np.quantile([abs(got[i]["score"] - want[i]) / n[i] for i in want], 0.95) < 0.05
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got.values())


def test_any_doc_id_is_kept(spark):
    ids = [-(1 << 63), None, (1 << 63) - 1, 0]
    rows = pitman_yor.score(spark, spark.createDataFrame([(i, "a b a") for i in ids], "doc_id long, text string")).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))


def test_predictive_sums_to_one():
    """Seating of one context and the root: probabilities over the vocabulary and the unknown word sum to one."""
    rng = np.random.default_rng(0)
    k = np.array([5, 1, 9, 2, 0])
    t, v = np.minimum(k, 1), 4
    many = np.flatnonzero(k > 1)
    for _ in range(20):
        t[many] = pitman_yor.gibbs_step(rng, k[many], t[many], 1 / (v + 1), np.full(len(many), t.sum()), pitman_yor.ROOT_D, pitman_yor.ROOT_THETA)
        assert ((t >= np.minimum(k, 1)) & (t <= k)).all()
    root = (np.maximum(k - pitman_yor.ROOT_D * t, 0) + (pitman_yor.ROOT_THETA + pitman_yor.ROOT_D * t.sum()) / (v + 1)) / (pitman_yor.ROOT_THETA + k.sum())
    assert abs(root.sum() - 1) < 1e-9


def one_restaurant(c):
    """A bucket of one context with these customers."""
    x = object.__new__(pitman_yor.Bucket)
    x.c, x.ctx, x.contexts = c, np.zeros(len(c), np.int64), np.array([7], np.uint64)
    return x


def test_seating_grows_with_customers():
    """Tables of a frequent context: as many as the restaurant that its customers were drawn from, and as in the long run."""
    d, theta, v, n, rng = pitman_yor.D, pitman_yor.THETA, 2000, 100_000, random.Random(5)
    h = 1 / np.arange(1, v + 1) / (1 / np.arange(1, v + 1)).sum()
    served = iter(np.searchsorted(np.cumsum(h), np.random.default_rng(1).random(n)).clip(0, v - 1).tolist())
    size, dish, seats, c = [], [], [], np.zeros(v, np.int64)
    for i in range(n):
        j = -1
        if rng.random() * (theta + i) >= theta + d * len(size):  # an old table, by its size less the discount
            while j < 0 or rng.random() * size[j] < d:
                j = seats[int(rng.random() * i)]
        if j < 0:
            j = len(size)
            size.append(0)
            dish.append(next(served))
        size[j] += 1
        seats.append(j)
        c[dish[j]] += 1
    place = pitman_yor.Placement(1, {})
    *_, (got, _) = one_restaurant(c).seat(place, np.zeros((0, 3)), np.stack([h, h]), 1, seed=1)
    *_, (later, _) = one_restaurant(c).seat(place, np.zeros((0, 3)), np.stack([h, h]), 100, seed=2)
    assert ((got >= np.minimum(c, 1)) & (got <= c)).all()
    assert abs(got.sum() / len(size) - 1) < 0.1 and abs(got.sum() / later.sum() - 1) < 0.05


def test_tables_are_drawn_by_their_chances():
    """Means of small dishes by the Stirling-weighted chances, and of large ones by the long run of single steps."""
    d, theta, rng = 0.8, 1.0, np.random.default_rng(4)
    logs = pitman_yor._stirling(d)[0]
    for c, h, others in ((2, 0.3, 5), (20, 0.05, 40), (96, 0.2, 80)):
        k = np.arange(1, c + 1)
        p = logs[c, 1:][:c] + np.cumsum(np.log((theta + d * (others + k - 1)) * h))
        p = np.exp(p - p.max())
        got = pitman_yor.draw_tables(rng, np.full(20_000, c), np.ones(20_000, int), h, np.full(20_000, others + 1.0), d, theta)
        assert abs(got.mean() - (p * k).sum() / p.sum()) < 0.03 * got.mean()
    c, h, others, n = 400, 0.1, 300, 500
    t = np.full(n, 40)
    for _ in range(4000):
        t = pitman_yor.gibbs_step(rng, np.full(n, c), t, h, others + t, d, theta)
    got = pitman_yor.draw_tables(rng, np.full(n, c), t, h, np.full(n, float(others)) + t, d, theta)
    assert abs(got.mean() / t.mean() - 1) < 0.05 and abs(got.std() / t.std() - 1) < 0.2


def test_alone_matches_enumeration():
    """Chance that one of c customers at t tables sits alone, over all partitions."""
    d, c = 0.8, 5
    table = pitman_yor._alone(d)

    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            for i in range(len(p)):
                yield p[:i] + [p[i] + [n]] + p[i + 1 :]
            yield [*p, [n]]

    weight = lambda p: math.prod(math.prod(j - d for j in range(1, len(b))) for b in p)
    for t in range(1, c + 1):
        of = [p for p in partitions(c) if len(p) == t]
        total = sum(map(weight, of))
        assert abs(sum(weight(p) for p in of if [c] in p) / total - table[c, t]) < 1e-9


# --- pipeline


def test_pipeline_stages(spark, documents):
    """Each stage against a plain version of its decision on its own input."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality.op3_quality_outliers(spark, DIR).collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, DIR).cache()
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in judged.items() if k}
    lined = corpus_pipeline.line_dedup(spark, kept, DIR).cache()
    c = duckdb.connect()
    c.register("documents", kept.select("doc_id", "text").toPandas())
    want = {i: t for i, _, t in c.sql(templates.ORACLES["op5_log_template_lines"]).fetchall()}
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    first: dict = {}
    for i in sorted(before):
        for line in before[i].split("\n"):
            first.setdefault(line, i)
    stay = {i for i, t in before.items() if any(x.split() and first[x] == i for x in t.split("\n"))}  # a line that no earlier document has
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == {i: t if t.split() else before[i] for i, t in want.items() if i in stay}
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    stay = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, lined, DIR).collect()}
    groups = collections.defaultdict(set)
    for r in simhash.near_duplicates(spark, lined).collect():
        groups[r["component_id"]].add(r["doc_id"])
    assert stay == set(groups) == {min(g) for g in groups.values()} and set().union(*groups.values()) == set(texts)
    packed = corpus_pipeline.run(spark, DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == stay
