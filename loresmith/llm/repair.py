"""Conversation structure repair: the cheapest edits that give a conversation its grammar.

A conversation's roles must read ``(s?(ua)+)?``. Rows are kept (0), given the role user or assistant (3),
deleted (4, required where blank or repeated) or preceded by an inserted empty turn (3 each); a truncated row
that stays adds 3. The least cost and, among equals, the ASCII-least audit are found by a recursive DuckDB
query inside batches dealt by hash: each recursion advances one row in all conversations of the batch and
keeps the minimum of (cost, audit) per grammar state. An audit fixes its cost, so of two with equal cost over the
same rows none begins with the other, and comparing what is known so far is exact.

Long conversations are cut into segments of SEGMENT rows, solved from every state they may begin in; two
neighbouring segments join at the state between them, in logarithmic rounds. So no task holds a conversation.
Only the repaired text's SHA-256, a sequence by definition, streams through one task a conversation, a row at a time.

Defined cases: null roles and texts, and null numbers in the damage key, are one space; rows of one
conversation and turn stand in order of role, first 100 characters and SHA-256 of the undamaged text; rows
without a conv_id are one conversation, returned with a null conv_id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm import turns
from loresmith.llm.store import Stash
from loresmith.llm.trie import crc32_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a segment; rows of a batch solved by one query.
SEGMENT, BATCH = 64, 20_000
#: Grammar states: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or renamed turn, and what ends a conversation: (cost, audit).
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: What a row shows: must be deleted, or the role's initial (o: another); capital where truncated.
GONE, CODES = "x", "xsuaoSUAO"
SPACES = " \t\n\x0b\f\r"
FIELDS = "conv string, seg long, start int, state int, cost long, audit string"


def edges() -> list[tuple[str, int, int, int, str]]:
    """(code, state, state after, cost, letters): the best insertions and edit of one row."""
    out = []
    for code in CODES:
        for state in range(4):
            best: dict[int, tuple[int, str]] = {}
            at, cost, letters = state, 0, ""
            for _ in range(3):  # two insertions lead from any state to any that they can reach
                steps = [(at, DELETE, "D")]
                if code != GONE:
                    more = TRUNCATED if code.isupper() else 0
                    kept = {"s": SYSTEM if at == START else None, "u": USER if at != USER else None, "a": ASSISTANT if at == USER else None}.get(code.lower())
                    steps += [(NEXT[at], REROLE + more, "R")] + ([(kept, KEEP + more, "K")] if kept is not None else [])
                for to, price, letter in steps:
                    best[to] = min(best.get(to, (1 << 30, "")), (cost + price, letters + letter))
                at, cost, letters = NEXT[at], cost + INSERT, letters + "I"
            out += [(code, state, to, c, a) for to, (c, a) in sorted(best.items())]
    return out


WALK = """
WITH RECURSIVE walk(unit, start, state, n, cost, audit) AS (
  SELECT unit, s.start, s.start, 0, 0::BIGINT, '' FROM units, (VALUES (0), (1), (2), (3)) AS s(start) WHERE seg > 0 OR s.start = 0
  UNION ALL
  SELECT unit, start, state, n, best.cost, best.audit FROM (
    SELECT w.unit, w.start, e.after AS state, w.n + 1 AS n, min({'cost': w.cost + e.cost, 'audit': w.audit || e.letters}) AS best
    FROM walk w JOIN units u ON u.unit = w.unit AND w.n < length(u.codes) JOIN edges e ON e.code = u.codes[w.n + 1] AND e.state = w.state
    GROUP BY w.unit, w.start, e.after, w.n))
SELECT u.conv, u.seg, w.start, w.state, w.cost, w.audit FROM walk w JOIN units u ON u.unit = w.unit AND w.n = length(u.codes)"""


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best (cost, audit) of each segment (conv, seg, codes) from each state to each."""
    import duckdb

    with duckdb.connect(config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""}) as db:
        db.execute("CREATE TABLE edges(code VARCHAR, state INT, after INT, cost INT, letters VARCHAR)")
        db.executemany("INSERT INTO edges VALUES (?, ?, ?, ?, ?)", edges())
        for b in batches:
            rows, most = pa.Table.from_batches([b]), max(1, BATCH // SEGMENT)
            for at in range(0, rows.num_rows, most):
                some = rows.slice(at, most)
                units = some.append_column("unit", pa.array(range(some.num_rows), pa.int64()))  # noqa: F841
                yield from db.sql(WALK).to_arrow_table().cast(_SOLVED).to_batches()


_SOLVED = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _best(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(F.struct("cost", "audit")).alias("_best")).select(*by, "_best.*")


def joined(parts: DataFrame, segments: int, stash: Stash) -> DataFrame:
    """``parts`` (conv, segs, seg, start, state, cost, audit) of segments joined in pairs until one is left a conversation: (conv, state, cost, audit)."""
    done = parts.where("segs = 1")
    rest = parts.where("segs > 1")
    first = None
    while segments > 1:
        left, right = rest.where("seg % 2 = 0"), rest.where("seg % 2 = 1")
        pair = left.alias("l").join(right.alias("r"), (F.col("l.conv") == F.col("r.conv")) & (F.col("l.seg") + 1 == F.col("r.seg")) & (F.col("l.state") == F.col("r.start")))
        pair = pair.select("l.conv", "l.segs", "l.seg", "l.start", "r.state", (F.col("l.cost") + F.col("r.cost")).alias("cost"), F.concat("l.audit", "r.audit").alias("audit"))
        alone = left.where("seg = segs - 1").select(*pair.columns)
        both = _best(pair, "conv", "segs", "seg", "start", "state").unionByName(alone)
        both = both.withColumn("seg", F.expr("seg div 2")).withColumn("segs", F.expr("(segs + 1) div 2"))
        segments = (segments + 1) // 2
        new = stash.put(both, f"segments{segments}")
        stash.drop(first)
        rest = first = new
        if segments == 1:
            done = done.unionByName(new.select(*done.columns))
    return done.select("conv", "state", "cost", "audit")


def given(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with what orders the rows. conv: the number as text, a space where null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    return rows.withColumn("was", F.col("role")).withColumn("head", F.substring("text", 1, 100)).withColumn("digest", F.sha2("text", 256)).withColumn("copy", F.lit(0))


def damaged(conversations: DataFrame) -> DataFrame:
    """``given``, after damage."""
    fault = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = given(conversations).withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, _at, code, blank, duplicate, truncated) of each row; the first fault counts."""
    first = rows.groupBy("conv", "role", F.sha2("text", 256).alias("said")).agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_new"))
    seen = rows.select("conv", "role", "_at", F.rtrim(F.col("text"), F.lit(SPACES)).alias("kept")).select("conv", "_at", F.substring("role", 1, 1).alias("initial"), F.right("kept", F.lit(1)).alias("end"))
    seen = seen.join(first, "_at", "left").withColumn("blank", F.col("end") == "").withColumn("duplicate", ~F.col("blank") & F.col("_new").isNull())
    seen = seen.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.col("end").isin(".", "!", "?"))
    shown = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), F.upper(shown)).otherwise(shown)
    return seen.select("conv", "_at", code.alias("code"), "blank", "duplicate", "truncated")


class Reading:
    """One conversation's rows, in order, under its audit: ``said`` gets each turn of the repaired one as (edit, role, text)."""

    def __init__(self, conv: str, audit: str, said: Callable[[str, str, str], None]):
        self.conv, self.audit, self.at, self.state, self.said = conv, audit, 0, START, said
        self.least, self.most, self.turns = None, None, 0
        self.before, self.illegal = None, 0

    def _next(self, edit: str, text: str) -> None:
        self.state = NEXT[self.state]
        self.said(edit, "user" if self.state == USER else "assistant", text)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._next("I", "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self.said(edit, role, text)
        elif edit == "R":
            self._next(edit, text)

    def counts(self) -> tuple[int, int]:
        """(gaps, illegal), once all rows are read."""
        self._inserted()
        return 0 if self.least is None else self.most - self.least + 1 - self.turns, self.illegal


def _readings(batches: Iterator[pa.RecordBatch], begin: Callable[[str], Callable[[str, str, str], None]]) -> Iterator[Reading | None]:
    """Readings of rows (conv, at, turn, role, text) in order of (conv, at), each as its last row is read; None after each batch.

    The row of ``at`` -1 has the audit as its text.
    """
    now: Reading | None = None
    for b in batches:
        columns = (b.column(i).to_pylist() for i in range(4))
        for conv, at, turn, role, text in zip(*columns, b.column(4), strict=True):
            if at < 0:
                if now is not None:
                    yield now
                now = Reading(conv, text.as_py(), begin(conv))
            else:
                now.row(turn, role, text.as_py())
        yield None
    if now is not None:
        yield now
    yield None


_DIGESTS = pa.schema([("conv", pa.string()), ("gaps", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = pa.schema([("conv", pa.string()), ("nth", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation; the repaired text is hashed as it comes."""
    sha, lines, out = hashlib.sha256(), 0, []

    def begin(conv: str) -> Callable[[str, str, str], None]:
        nonlocal sha, lines
        sha, lines = hashlib.sha256(), 0
        return say

    def say(edit: str, role: str, text: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + f"{role}:{text}").encode())
        lines += 1

    for r in _readings(batches, begin):
        if r is None:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)
            out = []
            continue
        gaps, illegal = r.counts()
        out.append({"conv": r.conv, "gaps": gaps, "illegal": illegal, "audit": r.audit, "repaired_sha256": sha.hexdigest()})


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns."""
    out, nth = [], 0

    def begin(conv: str) -> Callable[[str, str, str], None]:
        nonlocal nth
        nth = 0

        def say(edit: str, role: str, text: str) -> None:
            nonlocal nth
            out.append({"conv": conv, "nth": nth, "edit": edit, "role": role, "text": text})
            nth += 1

        return say

    for r in _readings(batches, begin):
        if r is not None:
            r.counts()
        else:
            yield pa.RecordBatch.from_pylist(out, schema=_TURNS)
            out.clear()


class Repair:
    """The audits of ``conversations`` (conv_id, turn, role, text), and what follows from them. damage: apply the contract's damage first."""

    def __init__(self, spark: SparkSession, conversations: DataFrame, *, damage: bool = False):
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        stash = Stash(spark, "repair")
        rows = damaged(conversations) if damage else given(conversations)
        self.rows = turns.sequenced(stash, rows, "conv", ["turn", "was", "head", "digest", "copy"], "rows").drop("was", "head", "digest", "copy")
        held = turns.runs(self.rows, "conv").select("conv", "_part", "_shift", F.col("_n").alias("size"))
        seen = faults(self.rows).withColumn("_part", turns.part()).join(held, ["conv", "_part"]).withColumn("place", F.col("_at") + F.col("_shift"))
        count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
        units = seen.groupBy("conv", F.expr(f"place div {SEGMENT}").alias("seg")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "").alias("codes"), F.expr(f"(max(size) + {SEGMENT - 1}) div {SEGMENT}").alias("segs"),
            *(count(c) for c in ("blank", "duplicate", "truncated")))
        units = stash.put(units, "units")
        solved = units.select("conv", "seg", "codes").repartition(self.parts, "conv", "seg").mapInArrow(solve, FIELDS)
        solved = stash.put(solved.join(units.select("conv", "seg", "segs"), ["conv", "seg"]), "solved")
        closed = joined(solved, units.agg(F.max("segs")).first()[0] or 1, stash)
        closing = lambda i: F.create_map(*(F.lit(x) for s, pair in CLOSING.items() for x in (s, pair[i])))[F.col("state")]
        #: (conv, cost, audit)
        self.audits = stash.put(_best(closed.select("conv", (F.col("cost") + closing(0)).alias("cost"), F.concat("audit", closing(1)).alias("audit")), "conv"), "audits")
        #: (conv, blank, duplicate, truncated)
        self.faults = units.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))

    def _read(self, run: Callable, schema: pa.Schema) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        stream = self.audits.select("conv", F.lit(-1).cast("long").alias("at"), none("long").alias("turn"), none("string").alias("role"), F.col("audit").alias("text"))
        stream = stream.unionByName(self.rows.select("conv", F.col("_at").alias("at"), "turn", "role", "text"))
        fields = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
        return stream.repartition(self.parts, "conv").sortWithinPartitions("conv", "at").mapInArrow(run, fields)

    def digests(self) -> DataFrame:
        """(conv, gaps, illegal, audit, repaired_sha256)."""
        return self._read(_digests, _DIGESTS)

    def repaired(self) -> DataFrame:
        """The repaired turns: (conv_id, nth, edit, role, text)."""
        return self._read(_turns, _TURNS).select(number("conv"), "nth", "edit", "role", "text")


def number(conv: str) -> F.Column:
    """The conv_id that a key stands for."""
    return F.when(F.col(conv) != " ", F.col(conv).cast("long")).alias("conv_id")


def audit_damaged(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The contract's row for every conversation of ``table`` (conv_id, turn, role, text)."""
    done = Repair(spark, table, damage=True)
    found = done.digests().join(done.audits.select("conv", "cost"), "conv").join(done.faults, "conv")
    every = given(table).select("conv").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(number("conv"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_damaged(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

#: Row by row over whole conversations, with every edit and up to two insertions spelt out.
ORACLES = {
    "op13_conversation_repair": f"""
WITH RECURSIVE
  given AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
  keys AS (SELECT c, turn, {crc32_sql("(c || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM (SELECT DISTINCT c, turn FROM given)),
  hit AS (SELECT g.c, g.turn, g.role AS was, left(g.text, 100) AS head, sha256(g.text) AS digest, fault, CASE WHEN fault = 4 THEN 'user' ELSE g.role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(g.text, '[.!?]', '', 'g') ELSE g.text END AS text FROM given g JOIN keys k ON k.c = g.c AND k.turn IS NOT DISTINCT FROM g.turn WHERE fault <> 0),
  copies AS (SELECT *, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit),
  seq AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, was, head, digest, copy) AS i FROM copies),
  ends AS (SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prev FROM seq),
  bad AS (SELECT *, tail = '' AS blank, tail <> '' AND again AS duplicate, tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS truncated FROM ends),
  counts AS (SELECT c, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(prev IS NOT NULL AND prev || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM bad GROUP BY c),
  walk(c, i, state, cost, audit) AS (
    SELECT c, 0::BIGINT, '', 0, '' FROM counts
    UNION ALL
    SELECT c, i, state, best.cost, best.audit FROM (
      SELECT w.c, w.i + 1 AS i, e.state, min({{'cost': w.cost + k * {INSERT} + e.cost, 'audit': w.audit || repeat('I', k) || e.letter}}) AS best
      FROM walk w JOIN bad b ON b.c = w.c AND b.i = w.i + 1, (VALUES (0), (1), (2)) AS ins(k),
        LATERAL (SELECT CASE WHEN k = 0 THEN w.state WHEN (w.state = 'u') = (k = 1) THEN 'a' ELSE 'u' END AS s) AS x,
        LATERAL (SELECT 'D' AS letter, s AS state, {DELETE} AS cost
          UNION ALL SELECT 'R', CASE s WHEN 'u' THEN 'a' ELSE 'u' END, {REROLE} + CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END WHERE NOT (blank OR duplicate)
          UNION ALL SELECT 'K', left(role, 1), CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END WHERE NOT (blank OR duplicate) AND (s || left(role, 1)) IN ('s', 'u', 'su', 'ua', 'au')) AS e
      GROUP BY w.c, w.i, e.state)),
  closed AS (SELECT w.c, min({{'cost': cost + CASE state WHEN 'u' THEN {INSERT} WHEN 's' THEN {2 * INSERT} ELSE 0 END, 'audit': audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END}}) AS best
    FROM walk w JOIN counts ON counts.c = w.c AND w.i = n GROUP BY w.c),
  letters AS (SELECT c, j, best.audit[j] AS letter FROM closed, unnest(range(1, length(best.audit) + 1)) AS t(j)),
  numbered AS (SELECT c, j, letter, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY c ORDER BY j) AS i FROM letters),
  said AS (SELECT n.c, j, letter, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, CASE WHEN letter = 'K' THEN role END AS role, row_number() OVER (PARTITION BY n.c ORDER BY j) AS nth
    FROM numbered n LEFT JOIN bad b ON b.c = n.c AND b.i = n.i WHERE letter <> 'D'),
  spoken AS (SELECT *, bool_or(nth = 1 AND coalesce(left(role, 1) = 's', false)) OVER (PARTITION BY c) AS sys FROM said),
  texts AS (SELECT c, sha256(string_agg(coalesce(role, CASE WHEN (nth - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j)) AS digest FROM spoken GROUP BY c)
SELECT CASE WHEN o.c <> ' ' THEN o.c::BIGINT END AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(texts.digest, '{hashlib.sha256(b"").hexdigest()}') AS repaired_sha256
FROM (SELECT DISTINCT c FROM given) o LEFT JOIN counts ON counts.c = o.c LEFT JOIN closed ON closed.c = o.c LEFT JOIN texts ON texts.c = o.c"""
}
