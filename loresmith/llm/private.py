"""Personal data: weak labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Candidates are all spans of the base rules and more: cards and phones inside digit runs that a base rule
drops as a whole (a card number next to an address or a phone), phones without a plus, spelt-out email addresses,
IPv6 and defanged addresses. Every candidate must be valid in itself: a card passes Luhn, a phone has 9 to 15 digits.

Six labelers vote yes, no or nothing: the strict pattern; arithmetic (digits of the country's numbers, network
ranges, label rules; for cards, that the issuer has numbers of this length); a gazetteer (issuers, country codes, top-level
domains); words around that speak for the kind; words around that speak against it; and how the span is set
(inside a longer token or after an assignment, or free). How often each pattern of votes and shape
occurs is counted over all documents, in cells of a fixed grid (``CELLS`` at most). Expectation-maximisation over the
cells estimates, for each kind, how often each labeler votes how on true and on false spans; and a logistic
regression of votes and shape is trained on the resulting probabilities. It decides which candidates are spans
beside the base ones, which always are.

Of candidates that overlap, the likeliest stays, then the first, then the longest. None overlaps a base span that
the classifier believes; one that it doubts (a card number run together with the end of an address) hides nothing.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; repeated rows give the same; an
empty table gives no rows; other columns are ignored. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "arithmetic", "gazetteer", "words for", "words against", "setting")
#: Shape: groups of digits (0 to 3 and more), what stands before and after (nothing or space, punctuation, a word), part of a longer run.
SHAPE = (4, 3, 3, 2)
CELLS = len(KINDS) * 3 ** len(LABELERS) * int(np.prod(SHAPE))
#: Characters around a span in which words are looked for.
AROUND = 48
#: EM: pseudo-counts, rounds, change that ends it. Regression: ridge, Newton steps. Probability from which a candidate is a span.
SMOOTH, ROUNDS, SETTLED = 0.5, 200, 1e-9
RIDGE, NEWTON = 1.0, 30
ACCEPT = 0.5

# Words around, top-level domains, country codes with the digits of their numbers (code included), issuers' first digits with lengths.
WORDS_FOR = {
    "email": "mail e-mail email contact write reach address correo courriel kontakt schreiben escribir reply send",
    "ip": "ip host server address addr client login connect connection ping route gateway subnet port serveur servidor adresse",
    "card": "card visa mastercard amex credit debit payment pay karte kreditkarte tarjeta carte cvv expires expiry",
    "phone": "phone tel telephone call mobile cell fax contact text dial whatsapp telefon anrufen handy teléfono llamar móvil téléphone appeler portable",
}
WORDS_AGAINST = {
    "email": "decorator npm version package handle",
    "ip": "version release v ver build section chapter kapitel clause isbn update",
    "card": "order invoice serial isbn id ref reference tracking token hash checksum timestamp bestellung pedido commande",
    "phone": "order invoice serial isbn id ref reference tracking token hash score version bestellung pedido commande",
}
DOMAINS = "com org net edu gov mil int info biz name io ai app dev me co us uk ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg dk se no fi is ee lv lt ru ua tr il in cn jp kr hk sg tw th vn id my ph br mx ar cl pe za ng ke eg eu"
NUMBERS = {
    "1": (11,), "7": (11,), "20": (11, 12), "27": (11,), "30": (12,), "31": (11,), "32": (10, 11), "33": (11,), "34": (11,), "36": (10, 11), "39": (11, 12, 13), "40": (11,), "41": (11,), "43": (11, 12, 13), "44": (12,), "45": (10,),
    "46": (10, 11), "47": (10,), "48": (11,), "49": (11, 12, 13, 14), "51": (11,), "52": (12,), "54": (12, 13), "55": (12, 13), "56": (11,), "57": (12,), "60": (11, 12), "61": (11,), "62": (11, 12, 13), "63": (12,), "64": (10, 11, 12),
    "65": (10,), "66": (11,), "81": (11, 12), "82": (11, 12), "84": (11,), "86": (13,), "90": (12,), "91": (12,), "351": (12,), "352": (11, 12), "353": (11, 12), "358": (11, 12, 13), "380": (12,), "420": (12,), "852": (11,), "972": (11, 12),
}
ISSUERS = ((r"4", (13, 16, 19)), (r"5[1-5]|2[2-7]", (16,)), (r"3[47]", (15,)), (r"6011|65|64[4-9]", (16, 19)), (r"35", (16, 19)), (r"3[068]", (14, 16, 19)), (r"62", (16, 17, 18, 19)), (r"50|5[6-9]|6[37]", (13, 14, 15, 16, 17, 18, 19)))

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is entered at its begin alone: what fails there fails at its other digits too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
_AT, _DOT = r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|@|\s@\s", r"\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+|\."
_SPELT = re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}+(?:{_AT})[A-Za-z0-9-]{{1,63}}+(?:(?:{_DOT})[A-Za-z0-9-]{{1,63}}+){{1,8}}", re.I)
_SPELT_SIGN = re.compile(r"[\[({<]\s?(?:at|dot)\s?[\])}>]|\sdot\s", re.I)
_DEFANGED = re.compile(r"(?<![0-9.\w])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s?\[dot\]\s?)[0-9]{1,3}){3}(?![0-9.]*[0-9\w])")
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")
_NATIONAL = re.compile(r"(?<![\w+.)-])(?:\([0-9]{2,5}\)|00?[0-9]{1,5}|[0-9]{3})(?:[ ./-]\s?[0-9]{2,5}){2,5}(?![\w])")
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{2,5}\) ?[0-9]{3,4}[ -][0-9]{3,4}"),
}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_ASSIGNED = re.compile(r"[\w]\s?=\s?[\"']?\w*$")
_FOR, _AGAINST = ({k: frozenset(v.split()) for k, v in words.items()} for words in (WORDS_FOR, WORDS_AGAINST))
_TOP = frozenset(DOMAINS.split())
_ISSUER = tuple((re.compile(p), lengths) for p, lengths in ISSUERS)


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int
    base: bool
    #: Whether it is a part of a longer run of the kind's characters.
    part: bool = False


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base rule, found from their @: what stands before it as far as the characters of a local part reach."""
    at, last = text.find("@"), 0
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules; runs that a rule matches and then drops are ``part`` and not ``base``."""
    out = [Span(0, s, e, True) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append(Span(1, *m.span(), True))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        ok = 13 <= len(digits) <= 19 and luhn(digits)
        if ok or len(digits) > 13:
            out.append(Span(2, *m.span(), ok, not ok))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m:
            ok = 9 <= sum(map(str.isdigit, m[0])) <= 15
            out.append(Span(3, *m.span(), ok, not ok))
        at = text.find("+", m.end() if m else at + 1)
    return out


def _parts(text: str, run: Span) -> Iterator[Span]:
    """Candidates within a run that a base rule drops or takes as a whole."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start, run.end)]
    if run.kind == 2:
        for i, (s, _) in enumerate(groups):
            digits = ""
            for a, e in groups[i : i + 5]:
                digits += text[a:e]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and _STRICT["card"].fullmatch(text, s, e) and luhn(digits):
                    yield Span(2, s, e, False, True)
    else:
        n = 0
        for s, e in groups:
            n += e - s
            if n > 15:
                break
            if n >= 9:
                yield Span(3, run.start, e, False, True)


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and what else may be one: nothing that overlaps a base span of the strict pattern."""
    if not text:
        return [], []
    found = base_spans(text)
    base = [s for s in found if s.base]
    plain = [s for s in base if _STRICT[KINDS[s.kind]].fullmatch(text, s.start, s.end)]
    sure = set(plain)
    more = [p for s in found if s.kind > 1 and s not in sure for p in _parts(text, s) if (p.start, p.end) != (s.start, s.end)]
    if _SPELT_SIGN.search(text):
        more += [Span(0, *m.span(), False) for m in _SPELT.finditer(text)]
        more += [Span(1, *m.span(), False) for m in _DEFANGED.finditer(text) if all(int(x) <= 255 for x in _GROUP.findall(m[0]))]
    elif "[.]" in text or "(.)" in text:
        more += [Span(1, *m.span(), False) for m in _DEFANGED.finditer(text) if all(int(x) <= 255 for x in _GROUP.findall(m[0]))]
    if "::" in text or text.count(":") >= 7:
        more += [Span(1, *m.span(), False) for m in _IPV6.finditer(text) if m[0].count(":") >= 3]
    for m in _NATIONAL.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            more.append(Span(3, *m.span(), False))
    if more:
        taken = sorted((s.start, s.end) for s in plain)
        more = [s for s in dict.fromkeys(more) if not _overlaps(taken, s)]
    return base, more


def _overlaps(taken: list[tuple[int, int]], s: Span) -> bool:
    """Whether a span meets one of the sorted spans; those of one kind do not overlap, so few begin just before it."""
    i = bisect_left(taken, (s.end, 0))
    return any(e > s.start for _, e in taken[max(0, i - len(KINDS)) : i])


def _setting(text: str, s: Span) -> tuple[int, int, int]:
    """What stands before and after a span (0 nothing or space, 1 punctuation, 2 a word), and the labeler's vote."""
    kinds = []
    for c in (text[s.start - 1 : s.start] if s.start else "", text[s.end : s.end + 1]):
        kinds.append(0 if not c or c.isspace() else 2 if c.isalnum() or c == "_" else 1)
    if 2 in kinds or _ASSIGNED.search(text, max(0, s.start - AROUND), s.start):
        return kinds[0], kinds[1], -1
    return kinds[0], kinds[1], 1


def _number(digits: str, plus: bool) -> tuple[int, int]:
    """(arithmetic, gazetteer) votes on a phone number."""
    if not plus:
        return (1 if digits.startswith("00") or len(digits) in (9, 10, 11) else -1), 0
    code = next((digits[:n] for n in (3, 2, 1) if digits[:n] in NUMBERS), None)
    return (0, -1) if code is None else (1 if len(digits) in NUMBERS[code] else -1, 1)


def votes(text: str, s: Span) -> tuple[int, ...]:
    """The labelers' votes on a candidate, then its shape."""
    kind, said = KINDS[s.kind], text[s.start : s.end]
    digits = "".join(_GROUP.findall(said))
    pattern = 1 if _STRICT[kind].fullmatch(said) else -1
    if kind == "email":
        labels = re.split(_DOT, re.split(_AT, said, maxsplit=1, flags=re.I)[-1], flags=re.I)
        arithmetic = 1 if all(x and x[0] != "-" and x[-1] != "-" and len(x) <= 63 for x in labels) else -1
        gazetteer = 1 if labels[-1].lower() in _TOP else -1
        pattern = 0 if pattern < 0 and _SPELT_SIGN.search(said) else pattern
    elif kind == "ip":
        if ":" in said:
            pattern, arithmetic, gazetteer = 0, 1 if said.count(":") == 7 or "::" in said else -1, 1 if re.match(r"(?i)[23]|f[cde]|::", said) else -1
        else:
            first = int(_GROUP.findall(said)[0])
            arithmetic, gazetteer = (1 if 1 <= first <= 223 else -1), 0 if first > 9 else -1
            pattern = 0 if pattern < 0 and ("[" in said or "(" in said) else pattern
    elif kind == "card":
        lengths = [x for p, x in _ISSUER if p.match(digits)]
        arithmetic, gazetteer = (1 if any(len(digits) in x for x in lengths) else -1), 1 if lengths else -1
    else:
        arithmetic, gazetteer = _number(digits, said.startswith("+"))
    words = {w.lower() for w in _WORD.findall(text, max(0, s.start - AROUND), s.start)} | {w.lower() for w in _WORD.findall(text, s.end, s.end + AROUND // 2)}
    before, after, setting = _setting(text, s)
    groups = min(3, len(_GROUP.findall(said)))
    return pattern, arithmetic, gazetteer, 1 if words & _FOR[kind] else 0, -1 if words & _AGAINST[kind] else 0, setting, groups, before, after, int(s.part)


class Model:
    """Reliabilities by kind and labeler, and a classifier by kind."""

    def __init__(self, cells: dict[tuple[int, ...], int]):
        """cells: documents' candidates by (kind, votes, shape)."""
        self.prior, self.reliability, self.weights = {}, {}, {}
        for k in range(len(KINDS)):
            own = {c[1:]: n for c, n in sorted(cells.items()) if c[0] == k}
            if own:
                rows, n = np.array(list(own)), np.array(list(own.values()), float)
                truth = self._reliabilities(k, rows[:, : len(LABELERS)], n)
                self.weights[k] = self._regression(self.features(rows), n, truth)

    def _reliabilities(self, kind: int, said: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The probability that each cell's candidates are true, by EM; it begins with the sum of the votes."""
        shown = np.stack([said == v for v in (-1, 0, 1)], axis=2).astype(float)  # cells x labelers x votes
        truth = 1 / (1 + np.exp(-1.5 * said.sum(axis=1)))
        for _ in range(ROUNDS):
            weight = np.stack([n * (1 - truth), n * truth])
            prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
            rate = np.einsum("tc,cjv->tjv", weight, shown) + SMOOTH
            rate /= rate.sum(axis=2, keepdims=True)
            log = np.log(prior)[:, None] + np.einsum("cjv,tjv->tc", shown, np.log(rate))
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
            moved, truth = np.abs(new - truth).max(), new
            if moved < SETTLED:
                break
        self.prior[kind], self.reliability[kind] = float(prior[1]), rate
        return truth

    @staticmethod
    def features(rows: np.ndarray) -> np.ndarray:
        """One column for each vote of each labeler and each value of the shape, and a constant."""
        cols = [rows[:, j] == v for j in range(len(LABELERS)) for v in (-1, 0, 1)]
        cols += [rows[:, len(LABELERS) + i] == v for i, most in enumerate(SHAPE) for v in range(most)]
        return np.stack([np.ones(len(rows), bool), *cols], axis=1).astype(float)

    @staticmethod
    def _regression(x: np.ndarray, n: np.ndarray, truth: np.ndarray) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(NEWTON):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (n * (truth - p)) - RIDGE * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def probability(self, kind: int, row: tuple[int, ...]) -> float:
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(np.array([row])) @ self.weights[kind], -30, 30)[0])))


def fit(docs: DataFrame) -> Model:
    """The model of all candidates of ``docs``; at most one row a cell of the grid comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                if text:
                    cells.update((s.kind, *votes(text, s)) for some in candidates(text) for s in some)
        columns = zip(*((*c, n) for c, n in cells.items()), strict=True) if cells else [()] * 12
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    names = ["kind", *(f"v{i}" for i in range(len(LABELERS))), *(f"s{i}" for i in range(len(SHAPE))), "n"]
    found = docs.select("text").mapInArrow(count, ", ".join(f"{c} long" for c in names)).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
    return Model({tuple(r)[:-1]: r["n"] for r in found.collect()})


def decided(text: str, model: Model, known: dict) -> list[tuple[Span, float]]:
    """The spans of a text with their probabilities (1 for base ones), by kind and start. known: probabilities by cell so far."""
    base, more = candidates(text)
    out, scored = [(s, 1.0) for s in base], []
    if not more:
        return sorted(out, key=lambda x: (x[0].kind, x[0].start))

    def probability(s: Span) -> float:
        cell = (s.kind, *votes(text, s))
        if cell not in known:
            known[cell] = model.probability(cell[0], cell[1:])
        return known[cell]

    believed = sorted((s.start, s.end) for s in base if probability(s) >= ACCEPT)
    for s in more:
        p = probability(s)
        if p >= ACCEPT and not _overlaps(believed, s):
            scored.append((s, p))
    scored.sort(key=lambda x: (-x[1], x[0].start, -x[0].end))
    out += _apart(scored)
    return sorted(out, key=lambda x: (x[0].kind, x[0].start))


def _apart(scored: Iterable[tuple[Span, float]]) -> list[tuple[Span, float]]:
    """Those that overlap none before them."""
    taken: list[tuple[int, int]] = []
    out = []
    for s, p in scored:
        i = bisect_left(taken, (s.end, 0))
        if i == 0 or taken[i - 1][1] <= s.start:
            insort(taken, (s.start, s.end))
            out.append((s, p))
    return out


FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,text:string,probability:double,base:boolean>>"


def find(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text); start and end are code points, spans stand by kind and start."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    model = model or fit(docs)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("probability", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            spans = []
            for t in b.column(1):
                text = t.as_py() or ""
                spans.append([(KINDS[s.kind], s.start, s.end, text[s.start : s.end], p, s.base) for s, p in decided(text, model, known)])
            rows = [[dict(zip(("kind", "start", "end", "text", "probability", "base"), s, strict=True)) for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return docs.mapInArrow(run, FOUND)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
ORACLES: dict[str, str] = {}
