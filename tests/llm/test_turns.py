"""Prefix trie, structure repair and personal data, each held to a plain version of it."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loresmith.llm import private, repair, trie

DIR = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:100], sha(r[3])))


# --- prefix trie ---------------------------------------------------------------------------------


def plain_trie(rows, share):
    """Every node from all prefixes of all rebuilt conversations."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((c, t, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in in_order(x)] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % share
        made[c] = tuple(own.get(c - c % 100, [])[:h] + x[h:])
    nodes = {}
    for c, x in made.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    out = []
    for x, members in nodes.items():
        below = [y for y in nodes if y[: len(x)] == x]
        leaves = [y for y in below if not any(len(z) == len(y) + 1 and z[: len(y)] == y for z in below)]
        saved = sum((len(nodes[y]) - 1) * (len(y[-1][1]) if y else 0) for y in below)
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(x))
        kids = sum(len(y) == len(x) + 1 for y in below)
        out.append((min(members), len(x), min(nodes[x[:-1]]) if x else None, len(members), kids, len(leaves), saved, sha(ends)))
    return sorted(out, key=str)


def talks(seed, n, *, turns=9):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, turns)):
            out.append((c * 7 % 400, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", "system", None]), rnd.choice(["a", "b.", None, "ß\n", "where?", ""])))
    return out


@pytest.mark.parametrize("share", [trie.SHARE, 1])
def test_trie(spark, share):
    rows = talks(1, 120) + [(None, 0, "user", "x")] + [(900, t, "user", f"{t % 7}") for t in range(70)] + [(901, t, "user", f"{t % 7}") for t in range(66)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("key", "conv", "depth", "parent", "_part")})
    got = trie.prefix_trie(spark, df, share=share).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows, share)
    assert trie.prefix_trie(spark, spark.createDataFrame([], ROWS)).collect() == []


def test_trie_pieces_and_blocks(spark, monkeypatch):
    """Joined numbers in many pieces and sums in many blocks give the same."""
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "BLOCK", 3)
    rows = [(c, t, "user", "same") for c in range(100, 160) for t in range(8)] + talks(5, 30)
    assert sorted((tuple(r) for r in trie.prefix_trie(spark, spark.createDataFrame(rows, ROWS), share=trie.SHARE).collect()), key=str) == plain_trie(rows, trie.SHARE)
    batch = pa.RecordBatch.from_pydict({"key": ["k"] * 50, "conv": list(range(50))})
    pieces = [p for b in trie._joined(iter([batch])) for p in b.column(2).to_pylist()]
    assert len(pieces) > 5 and ",".join(pieces) == ",".join(map(str, range(50)))


# --- structure repair ----------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 0:
            continue
        new = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, t, role, text, "user" if fault == 4 else role, new)] * (2 if fault == 3 else 1)
    return [(t, role, text) for _, t, _, _, role, text in in_order(out)]


def plain_faults(seq):
    out, seen = [], set()
    for _, role, text in seq:
        kept = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_best(seq, faults):
    """The cheapest, then ASCII-least audit by trying every edit of every row."""
    n, best = len(seq), None
    options = []
    for (_, role, _), fault in zip(seq, faults, strict=True):
        own = [("D", "", 4)]
        if fault in ("", "truncated"):
            more = 3 if fault else 0
            own += [("K", role[:1], more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        options.append(own)
    for picks in itertools.product(*options):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=n + 1):
            cost = sum(p[2] for p in picks) + 3 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            roles = gaps[0] + "".join(p[1] + g for p, g in zip(picks, gaps[1:], strict=True))
            if any(p[0] == "K" and not p[1] for p in picks) or not re.fullmatch("(s?(ua)+)?", roles):
                continue
            audit = "I" * len(gaps[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(picks, gaps[1:], strict=True))
            if best is None or (cost, audit) < best:
                best = (cost, audit)
    return best or (0, "")


def test_best_audit_against_all(spark):
    """The recursive query's choice is the least of all edits."""
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rnd.choice(["a.", "b", "c!", " ", "d?"])) for c in range(150) for t in range(rnd.randint(1, 4))]
    got = {r["conv_id"]: r for r in repair.audit_damaged(spark, spark.createDataFrame(rows, ROWS)).collect()}
    assert len(got) == 150
    for c in got:
        seq = plain_damage([r for r in rows if r[0] == c])
        if len(seq) <= 4:
            assert (got[c]["cost"], got[c]["audit"]) == plain_best(seq, plain_faults(seq)), (c, seq)


def follow(seq, audit):
    """Lines of the repaired conversation."""
    out, i, said = [], 0, ""
    for edit in audit:
        if edit == "I" or edit == "R":
            role = "assistant" if said[-1:] == "u" else "user"
            out.append((role, "" if edit == "I" else seq[i][2]))
            said += role[0]
        elif edit == "K":
            out.append((seq[i][1], seq[i][2]))
            said += seq[i][1][0]
        i += edit != "I"
    assert i == len(seq) and re.fullmatch("(s?(ua)+)?", said)
    return out


AUDITS = []


@pytest.mark.parametrize("segment", [repair.SEGMENT, 3])
def test_repair(spark, monkeypatch, segment):
    """Counts, digests and odd rows; segments of any length give the same audits."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = talks(9, 80, turns=14) + [(None, None, None, None), (-5, 3, "user", "ok."), (5000, None, "user", "x" * 50_000 + ".")]
    rows += [(7000, t, ("user", "assistant", "tool")[t % 3], f"line {t % 40}{'.' * (t % 5 > 0)}") for t in range(150)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("conv", "code", "seg", "audit", "cost", "_at")})
    got = {r["conv_id"]: r.asDict() for r in repair.audit_damaged(spark, df).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        seq = plain_damage([x for x in rows if x[0] == c])
        faults, turns = plain_faults(seq), [t for t, *_ in seq if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(seq)]
        want = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}}
        assert {k: r[k] for k in want} == want, c
        lines = follow(seq, r["audit"])
        assert r["repaired_sha256"] == sha("\n".join(f"{a}:{b}" for a, b in lines))
        edits = re.findall("[DKR]", r["audit"])
        assert all(e == "D" for e, f in zip(edits, faults, strict=True) if f in ("blank", "duplicate"))
        assert r["cost"] == 3 * r["audit"].count("I") + 4 * edits.count("D") + 3 * edits.count("R") + sum(3 for e, f in zip(edits, faults, strict=True) if f == "truncated" and e != "D")
    AUDITS.append({c: (r["audit"], r["cost"]) for c, r in got.items()})
    assert AUDITS[-1] == AUDITS[0]
    assert repair.audit_damaged(spark, spark.createDataFrame([], ROWS)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "hello."), (1, 2, "assistant", ""), (2, 0, "user", "q?"), (2, 1, "user", "q?"), (2, 2, "assistant", "a.")]
    got = repair.Repair(spark, spark.createDataFrame(rows, ROWS)).repaired().orderBy("conv_id", "nth").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in got] == [(1, "K", "system", "s."), (1, "I", "user", ""), (1, "K", "assistant", "hello."), (2, "K", "user", "q?"), (2, "K", "assistant", "a.")]


# --- personal data -------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def passes(number):
    total = 0
    for i, c in enumerate(number[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and passes(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_rules():
    rnd = random.Random(2)
    for _ in range(60_000):
        t = "".join(rnd.choice("a12.@@-+ (é0") for _ in range(rnd.randint(0, 28)))
        assert sorted((private.KINDS[s.kind], s.start, s.end) for s in private.base_spans(t) if s.base) == sorted(plain_spans(t)), t


def card(rnd, first="4"):
    n = first + "".join(rnd.choice("0123456789") for _ in range(15 - len(first)))
    return n + next(c for c in "0123456789" if passes(n + c))


def corpus(seed, n):
    """(doc_id, text, spans that the base rules miss, spots that are none)."""
    rnd = random.Random(seed)
    words = "red stone over tall winter river and garden of maps".split()
    out = []
    for i in range(n):
        kind, lead, tail = i % 9, " ".join(rnd.choices(words, k=8)), " ".join(rnd.choices(words, k=8))
        phone = f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        ip = f"{rnd.randint(10, 223)}.{rnd.randint(0, 255)}.{rnd.randint(100, 255)}.{rnd.randint(10, 99)}"
        hidden, plain = None, ""
        if kind == 0:
            plain = card(rnd)
        elif kind == 1:
            plain = phone
        elif kind == 2:
            plain = f"{rnd.choice(words)}.{i}@mail{i % 10}.example.com"
        elif kind == 3:
            hidden = ("card", card(rnd))
            lead += f" {ip}" if rnd.random() < 0.5 else " 77"
            plain = hidden[1]
        elif kind == 4:
            hidden = ("phone", phone)
            plain, tail = phone, f"{card(rnd)[:9]}{rnd.randint(100, 999)} {tail}"
        elif kind == 5:
            hidden = ("email", f"{rnd.choice(words)} [at] mail{i % 10} [dot] com")
            plain = hidden[1]
        elif kind == 6:
            plain = 'token = "' + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + '"'
        elif kind == 7:
            plain = "order " + "9" + "".join(rnd.choice("0123456789") for _ in range(15))
            while passes(digits(plain)):
                plain = plain[:-1] + rnd.choice("0123456789")
        text = f"{lead} {plain} {tail}"
        at = len(lead) + 1
        out.append((i, text, (hidden[0], at, at + len(hidden[1])) if hidden else None))
    return out


def test_labelers_and_classifier_on_held_out_documents(spark):
    """Fitted without labels on some documents, spans of others: hidden ones found, no others added."""
    docs = corpus(11, 900)
    model = private.fit(spark.createDataFrame([(i, t) for i, t, _ in docs[:450]], "doc_id long, text string"))
    held = docs[450:]
    got = {r["doc_id"]: r["spans"] for r in private.find(spark, spark.createDataFrame([(i, t) for i, t, _ in held], "doc_id long, text string"), model).collect()}
    wanted = found = extra = 0
    for i, t, hidden in held:
        base = [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]]
        assert sorted(base) == sorted(plain_spans(t)) and all(s["text"] == t[s["start"] : s["end"]] for s in got[i])
        more = [(s["kind"], s["start"], s["end"]) for s in got[i] if not s["base"]]
        missed = hidden is not None and hidden not in base
        wanted += missed
        found += missed and hidden in more
        extra += sum(s != hidden for s in more)
    assert wanted > 80 and found >= 0.95 * wanted and extra <= 0.02 * len(held)


def test_reliabilities_are_those_of_the_labelers():
    """EM recovers how often simulated labelers are right, without the truth."""
    import numpy as np

    rnd = np.random.default_rng(5)
    right = (0.95, 0.9, 0.8, 0.75, 0.7, 0.9)
    truth = rnd.random(40_000) < 0.6
    said = np.stack([np.where(rnd.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    cells = {}
    for row in said:
        cells[(0, *map(int, row), 1, 0, 0, 0)] = cells.get((0, *map(int, row), 1, 0, 0, 0), 0) + 1
    model = private.Model(cells)
    assert abs(model.prior[0] - 0.6) < 0.02
    for j, r in enumerate(right):
        assert abs(model.reliability[0][1, j, 2] - r) < 0.02 and abs(model.reliability[0][0, j, 0] - r) < 0.02


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "x" * 200_000 + "@"), (4, "9" * 200_000), (5, "1 " * 100_000), (6, "a@" * 50_000), (7, "+1" * 50_000), (8, "1." * 100_000), (9, ":" * 100_000), (3, "x" * 200_000 + "@"), (10, " at " * 50_000 + " dot ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = private.find(spark, df).collect()
    assert len(got) == len(rows) and next(r for r in got if r["doc_id"] is None)["spans"][0]["text"] == "a@b.c"
    assert private.find(spark, df.where("false")).collect() == []
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in private.op12_personal_data(spark, DIR).collect():
        spans = sorted(plain_spans(docs[r["doc_id"]]), key=lambda s: (private.KINDS.index(s[0]), s[1]))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == sha(text) and set(filter(None, text.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in private.KINDS] == [sum(s[0] == k for s in spans) for k in private.KINDS]
