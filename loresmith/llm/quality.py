"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every text becomes counts, and the counts a vector of transformed statistics. For each language and
source, and for each language as their parent, concentration steps look for the ``SHARE`` of the rows
with the smallest covariance determinant: the covariance of the rows chosen gives Mahalanobis
distances, the nearest rows are chosen next, until the determinant falls no more. Covariances are
regularised, by ``FLOOR`` squared added to their diagonal, so that statistics that are constant in a
group have an inverse. The steps start from the coordinate-wise medians, once with the rows' own
spread and once with the narrowest that is allowed, and the smaller determinant wins. Then mean and
covariance are taken anew over all rows within the ``REWEIGHTED`` quantile of chi-squared.

A step is one grouped sum over all rows: rows are binned by distance (``BINS`` to a doubling), moments are
summed by bin on the map side, and the bins nearest to the centre that hold the wanted share give the
next estimate. No group is ever gathered: a task sees at most the bins of one group.

Texts are not normal, least of all short ones. So a group's squared distances are raised to a power
and scaled until their median and upper quartile are those of chi-squared (the power is never over 1, so a
tail is only drawn in); a row is rejected when its distance so calibrated is beyond the quantile that a
normal sample's pass with probability ``LEVEL``.

Groups of fewer than ``LEAST_ROWS`` rows use their language's estimate, languages with fewer that of
the whole table, and a table with fewer a wide fixed one. Defined cases: null texts have no words
(and fail the base rule); null languages and sources are groups of their own; repeated rows count
as often as they stand; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm.store import Stash

WINDOW = 8
STATS = (
    "doc_id long, row_key long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "x0 double, x1 double, x2 double, x3 double, x4 double, x5 double"
)
P = 6
#: Smallest standard deviation that a statistic is given, and where and how wide estimates start without data.
FLOOR = np.array([0.10, 0.25, 1.50, 0.25, 0.25, 1.00])
#: Share of rows that an estimate rests on, concentration steps at most, fall of a logarithm of a determinant that
#: still counts, bins to a doubling of the squared distance.
SHARE, STEPS, FALL, BINS = 0.75, 30, 1e-2, 40
LEAST_ROWS, SALTS = 100, 32
#: Chances of a normal sample's row to be left out when estimates are taken anew, and to be rejected.
REWEIGHTED, LEVEL = 0.025, 1e-4


def chi_squared(chance: float) -> float:
    """Where the chi-squared distribution with P (even) degrees of freedom is passed with that chance."""
    beyond = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(P // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beyond(mid) > chance else (lo, mid)
    return lo


SPACE = b" \t\n\r\x0b\f"
SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of so many words that stand twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # ranks of windows by doubling: exact, no hashing
    rank, width, need = ids, 1, window
    code, done = None, 0
    while need:
        if need & 1:
            part = rank[done : done + n]
            code = part if code is None else np.unique(code * (int(part.max()) + 1) + part, return_inverse=True)[1]
            done += width
        need >>= 1
        if need:
            k = len(rank) - width
            rank = np.unique(rank[:k] * (int(rank.max()) + 1) + rank[width : width + k], return_inverse=True)[1]
            width *= 2
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, letters A-Z, digits, words like the one before."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    lines = [x for x in text.split("\n") if x.encode().strip(SPACE)]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), upper, upper + lower, digits, sum(map(eq, words, words[1:]))


def vector(c: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row a text: what long and short texts have alike.

    Mean word length, and by logarithm the shares of symbols, repeated windows, words like the one
    before, capitals and digits.
    """
    n = np.maximum(c[:, 0], 1)
    share = lambda x, of: np.log1p(100 * x / np.maximum(of, 1))
    return np.stack([np.log(np.maximum(c[:, 1], 1) / n), share(c[:, 2], n), share(c[:, 4], n), share(c[:, 8], n), share(c[:, 5], c[:, 6]), share(c[:, 7], c[:, 1])], axis=1)


def measure(docs: DataFrame) -> DataFrame:
    """Counts and vector of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.array([text_counts(t.as_py()) for t in b.column(4)], np.int64).reshape(-1, 9)
            x = vector(c.astype(float))
            cols = [*(b.column(i) for i in range(4)), *(pa.array(c[:, i]) for i in range(5)), *(pa.array(x[:, i].copy()) for i in range(P))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"x{i}" for i in range(P))])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, STATS)


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MODEL = "k1 string, k2 string, start int, n long, mu array<double>, inv array<double>, log_det double"


def _keys(df: DataFrame) -> DataFrame:
    """Each row under its group, its language and the whole table (keys never null)."""
    tag = lambda c: F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), c))
    levels = F.array(F.struct(tag("lang").alias("k1"), tag("source").alias("k2")), F.struct(tag("lang").alias("k1"), F.lit("").alias("k2")), F.struct(F.lit("").alias("k1"), F.lit("").alias("k2")))
    return df.withColumn("_k", F.explode(levels)).select("*", "_k.k1", "_k.k2").drop("_k")


def _distance(df: DataFrame) -> DataFrame:
    """d2: squared Mahalanobis distance under mu and inv, as one column expression."""
    dev = [F.col(f"x{i}") - F.col("mu")[i] for i in range(P)]
    d2 = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        d2 = d2 + dev[i] * dev[j] * F.col("inv")[k] * (1 if i == j else 2)
    return df.withColumn("d2", F.greatest(d2, F.lit(0.0)))


def _inverse(cov: np.ndarray) -> list[float]:
    """Upper triangle of the inverse of a regularised covariance."""
    inv = np.linalg.inv(cov + np.diag(FLOOR**2))
    return [float(inv[i, j]) for i, j in PAIRS]


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{k}") for k, (i, j) in enumerate(PAIRS))
    )


def _moments(rows: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    n = float(rows["n"].sum())
    mu = np.array([rows[f"s{i}"].sum() for i in range(P)]) / n
    cov = np.zeros((P, P))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = rows[f"q{k}"].sum() / n - mu[i] * mu[j]
    return n, mu, cov


def _estimate(pdf: pd.DataFrame, last: int) -> pd.DataFrame:
    """The estimate on the bins up to the last one."""
    _, mu, cov = _moments(pdf.iloc[: last + 1])
    log_det = float(np.linalg.slogdet(cov + np.diag(FLOOR**2))[1])
    head = {c: [pdf[c].iloc[0]] for c in ("k1", "k2", "start")}
    return pd.DataFrame({**head, "n": [int(pdf["n"].sum())], "mu": [mu.tolist()], "inv": [_inverse(cov)], "log_det": [log_det]})


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the bins of one group and start: the estimate on the nearest rows."""
    pdf = pdf.sort_values("bin")
    return _estimate(pdf, int(np.searchsorted(pdf["n"].cumsum().to_numpy(), SHARE * pdf["n"].sum())))


def _quantile(pdf: pd.DataFrame, share: float) -> float:
    """Squared distance of that quantile, from bins in order."""
    nth = int(np.searchsorted(pdf["n"].cumsum().to_numpy(), share * pdf["n"].sum()))
    return max(1e-9, 2.0 ** ((float(pdf["bin"].iloc[nth]) + 0.5) / BINS) - 1)


def _reweight(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the bins of one group: the estimate on all rows but those in a normal sample's tail."""
    pdf = pdf.sort_values("bin")
    edge = chi_squared(REWEIGHTED) * _quantile(pdf, 0.5) / chi_squared(0.5)
    return _estimate(pdf, max(int((pdf["bin"] <= math.log2(1 + edge) * BINS).sum()) - 1, 0))


def _calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the counts of one group's bins: its median distance, and the power that brings the upper quartile to chi-squared's."""
    pdf = pdf.sort_values("bin")
    middle, upper = _quantile(pdf, 0.5), _quantile(pdf, 0.75)
    power = math.log(chi_squared(0.25) / chi_squared(0.5)) / max(math.log(upper / middle), 1e-9)
    return pd.DataFrame({"k1": [pdf["k1"].iloc[0]], "k2": [pdf["k2"].iloc[0]], "middle": [max(middle, 0.05 * chi_squared(0.5))], "power": [min(1.0, power)]})


def estimates(stash: Stash, stats: DataFrame) -> DataFrame:
    """(k1, k2, n, mu, inv, middle, power) of each group, language and the table with enough rows."""
    salted = F.pmod("row_key", F.lit(SALTS)).cast("int").alias("salt")
    keyed = _keys(stats.select("lang", "source", salted, *(f"x{i}" for i in range(P))))
    quart = keyed.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(P))
    ).where(F.col("n") >= LEAST_ROWS)
    spread = lambda i, start: F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + float(FLOOR[i] ** 2) if start == 0 else F.lit(float(FLOOR[i] ** 2))
    starts = F.array(*(F.struct(F.lit(k).alias("start"), F.array(*(F.lit(0.0) if i != j else 1 / spread(i, k) for i, j in PAIRS)).alias("inv")) for k in range(2)))
    model = quart.select("k1", "k2", F.explode(starts).alias("s"), F.array(*(F.col(f"p{i}")[1] for i in range(P))).alias("mu"))
    model = model.select("k1", "k2", "s.start", "mu", "s.inv", F.lit(float("inf")).alias("log_det"))
    spots = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # a group may hold a third of all rows

    def binned(m: DataFrame) -> DataFrame:
        return _distance(keyed.join(m.select("k1", "k2", spots, "start", "mu", "inv"), ["k1", "k2", "salt"])).withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * BINS))

    def sums_of(m: DataFrame, step) -> DataFrame:
        return _sums(binned(m), "k1", "k2", "start", "bin").groupBy("k1", "k2", "start").applyInPandas(step, MODEL)

    model = stash.put(model.withColumn("moving", F.lit(True)), "model")
    fields = ("mu", "inv", "log_det")
    for _ in range(STEPS):
        if model.where("moving").isEmpty():
            break
        new = sums_of(model.where("moving"), _concentrate).select("k1", "k2", "start", F.struct(*fields).alias("now"))
        both = model.where("moving").join(new, ["k1", "k2", "start"])
        lower = F.col("now.log_det") < F.col("log_det")
        both = both.select("k1", "k2", "start", *(F.when(lower, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in fields), (F.col("log_det") - F.col("now.log_det") >= FALL).alias("moving"))
        now = stash.put(both.unionByName(model.where(~F.col("moving"))), "model")
        stash.drop(model)
        model = now
    best = model.groupBy("k1", "k2").agg(*(F.min_by(c, F.struct("log_det", "start")).alias(c) for c in ("start", "mu", "inv")))
    final = stash.put(sums_of(stash.put(best, "best"), _reweight), "final")
    counts = binned(final).groupBy("k1", "k2", "bin").agg(F.count(F.lit(1)).alias("n"))
    calibrated = counts.groupBy("k1", "k2").applyInPandas(_calibrate, "k1 string, k2 string, middle double, power double")
    return stash.put(final.select("k1", "k2", "n", "mu", "inv").join(calibrated, ["k1", "k2"]), "calibrated")


def judge(spark: SparkSession, docs: DataFrame, *, level: float = LEVEL) -> DataFrame:
    """Counts, base_failed, distance and kept of every row of ``docs`` (doc_id, text, lang, source).

    distance is the calibrated squared distance. row_key is the xxhash64 of doc_id and text, by which
    verdicts find their rows again.
    """
    stash = Stash(spark, "quality")
    stats = stash.put(measure(docs), "stats")
    model = estimates(stash, stats)
    tag = lambda c: F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), c))
    stats = stats.withColumns({"_l": tag("lang"), "_s": tag("source")})
    # each group with its own estimate or its nearest ancestor's; one row a group
    groups = stats.groupBy("_l", "_s").count().drop("count")
    parts = ("mu", "inv", "middle", "power")
    at = lambda name: F.struct(*(F.col(f"{name}.{c}").alias(c) for c in parts))
    whole = model.where("k1 = ''").select(*parts).first()  # one row
    mu, inv, middle, power = whole or ([0.0] * P, [0.0] * len(PAIRS), 1.0, 1.0)
    wide = F.struct(F.array(*map(F.lit, mu)).alias("mu"), F.array(*map(F.lit, inv)).alias("inv"), F.lit(middle).alias("middle"), F.lit(power).alias("power"))
    groups = (
        groups.join(model.alias("a"), (F.col("_l") == F.col("a.k1")) & (F.col("_s") == F.col("a.k2")), "left")
        .join(model.where("k2 = '' and k1 != ''").alias("b"), F.col("_l") == F.col("b.k1"), "left")
        .select("_l", "_s", F.when(F.col("a.n").isNotNull(), at("a")).when(F.col("b.n").isNotNull(), at("b")).otherwise(wide).alias("_m"))
    )
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    stats = stats.withColumn("_salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))
    judged = _distance(stats.join(groups, ["_l", "_s", "_salt"]).select("*", "_m.mu", "_m.inv", "_m.middle", "_m.power"))
    judged = judged.withColumn("distance", chi_squared(0.5) * F.pow(F.col("d2") / F.col("middle"), F.col("power")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("distance") <= chi_squared(level))).alias("kept"), "distance")


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")


QUERIES = {"op3_quality_outliers": op3_quality_outliers}
ORACLES: dict[str, str] = {}
