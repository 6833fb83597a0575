"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Base statistics come from whole texts. Each text's statistics are transformed to six numbers on
a grid of 1/512, so that all sums are exact integers: logarithms of word length, punctuation and
distinct words (each a share, drawn to a usual value as if by a few more words) and of words, and of
repeated words and lines by hundred words. These two are zero in most texts, so that a covariance
of half of the rows would be singular: a uniform number from the text's checksum is added to them.

The minimum covariance determinant is estimated over all rows of each language, then of each
language and source, by concentration steps: from three deterministic starts (medians with absolute
deviations, with the covariance of signs, with that of bounded values), take the mean and
covariance of the half of the rows with the smallest distances, and repeat. After two steps the
start with the least determinant goes on, until the determinant falls no more. The covariance is
made consistent for normal data, then taken again over all rows within the 0.975 quantile.
A group's covariance is drawn to the target, that of its language, as if by PRIOR_ROWS more rows
(the regularized form of the estimator, whose steps lower the determinant of the drawn covariance);
a language's, to PRIOR. So any group has an estimate of its own, and the draw fades with its size.

Every step is one partial aggregation of counts and moments by distance bin (of the bin in which
half is reached, a share counts), so a group of any size, also a hot one, is reduced before the
shuffle. Rows whose squared Mahalanobis distance exceeds a chi-square quantile are rejected.

Defined cases: a null or empty text has no words and fails the base rules; null languages and
sources form groups of their own; a group of one row has its language's estimate, all but; equal
rows get equal verdicts; extra columns are carried as they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.common import map_arrow, packed, runs, table
from voxlake.session import cut, release, stage

WINDOW = 8
GRID = 512
#: Steps of a group end when the logarithm of its determinant falls no more than that, or after so many; the best start goes on after two.
STEPS, TRIALS, LEAST_FALL = 25, 2, 1e-2
#: Rows are rejected beyond this quantile of chi-square: real statistics have longer tails than normal ones.
TAIL = 1 - 1e-10
#: Rows within this quantile give the final estimate.
CORE = 0.975
#: A group's estimate is drawn to its target as if by so many more rows.
PRIOR_ROWS = 50
#: A language's target: standard deviations of word length, punctuation, distinct words, words, repeated words and lines.
PRIOR = (0.1, 0.3, 0.2, 1.0, 0.4, 0.4)
#: Distance bins: 32 for each doubling.
BINS, TOP_BIN = 32, 1600
#: Estimates of so many groups at most (three of 1 KB each) are held on the driver and broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 5_000
#: Texts of more words are searched for repeats in arrays instead of sets of tuples.
LONG_TEXT = 200_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_marks", "n_distinct", "checksum")
P = len(PRIOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _covered(starts: np.ndarray, n: int) -> int:
    """Words in windows that begin at ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def repeat_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    m = n - WINDOW + 1
    if m < 2:
        return 0
    if n <= LONG_TEXT:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        first: dict = {}
        again = [i for i, w in enumerate(windows) if first.setdefault(w, i) != i] if len(set(windows)) < m else []
        if not again:
            return 0
        return _covered(np.array(sorted({*again, *(first[windows[i]] for i in again)})), n)
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    width = 1
    while width < WINDOW:  # ranks of pairs of windows: equal ranks, equal words
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    return _covered(np.flatnonzero(np.bincount(rank)[rank] > 1), n)


def base_stats(text: str | None) -> tuple[int, ...]:
    """STATS and MORE of a whole text: also its ASCII punctuation, its distinct words and its CRC-32."""
    if not text:
        return (0,) * len(STATS + MORE)
    raw = text.encode()
    words = raw.split()
    blank = sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = repeat_words(words)
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated, len(raw) - len(raw.translate(None, _MARKS)), len(set(words)), zlib.crc32(raw)


def _features() -> list[F.Column]:
    n = F.col("n_words")

    def share(part: str, usual: int, more: int) -> F.Column:
        return F.log((F.col(part) + usual) / (n + more))

    def events(part: str, shift: int) -> F.Column:
        jitter = F.shiftright("checksum", shift).bitwiseAND(0xFFFF) / 65536
        return F.log(0.5 + jitter + 100 * F.col(part) / (n + 100))

    found = (share("word_chars", 100, 20), share("n_marks", 3, 20), share("n_distinct", 20, 20), F.log(F.greatest(n, F.lit(1)) / 256), events("n_repeat_words", 0), events("n_dup_lines", 16))
    return [F.round(x * GRID).cast("long").alias(f"x{i}") for i, x in enumerate(found)]


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, y = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-15:
        term *= y / (a + i)
        total += term
        i += 1
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 1e-9, 4.0 * k * (1 + abs(NormalDist().inv_cdf(q))) ** 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """Makes the covariance of the innermost share of rows that of all rows, were they normal."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2) if share < 1 else 1.0


ESTIMATE = "g0 string, g1 string, start int, n long, center array<double>, cov array<double>, inverse array<double>, logdet double, done boolean, t_center array<double>, t_cov array<double>"
NAMES = [f.split()[0] for f in ESTIMATE.split(", ")]


def _matrix(x: object) -> np.ndarray:
    return np.array(x, dtype=float).reshape(P, P)


def drawn(cov: np.ndarray, n: int, target: np.ndarray) -> np.ndarray:
    """A covariance (grid units) drawn to the target as if by PRIOR_ROWS more rows; the grid's own rounding is added."""
    share = n / (n + PRIOR_ROWS)
    return share * cov + (1 - share) * target + np.eye(P) / 12


def _row(like: pd.Series, start: int, center: np.ndarray, cov: np.ndarray, done: bool = False) -> list:
    return [like["g0"], like["g1"], start, like["n"], center.tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]), done, list(like["t_center"]), list(like["t_cov"])]


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)]


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations (one grid step at least) of a group, from counts of each feature's grid values."""
    mean, scale = np.zeros(P), np.zeros(P)
    for k, part in pdf.groupby("k"):
        v, n = part["v"].to_numpy(), part["n"].to_numpy()
        mean[k] = _median(v, n)
        scale[k] = max(1.0, 1.4826 * _median(np.abs(v - mean[k]), n))
    return pd.DataFrame({"g0": [pdf["g0"].iloc[0]], "g1": [pdf["g1"].iloc[0]], "mid": [mean], "scale": [scale]})


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Three starts for each row, a group: shapes from absolute deviations alone, and from the moments of signs and bounded values."""
    out = []
    for _, r in pdf.iterrows():
        scale = np.outer(r["scale"], r["scale"])
        for start, name in enumerate(("", "s", "t")):
            shape = np.eye(P)
            for i, j in PAIRS if name else ():
                shape[i, j] = shape[j, i] = r[f"{name}{i}{j}"]
            # signs and bounded values have a smaller spread, the same in all directions; only the shape counts
            shape = shape * P / max(np.trace(shape), 1e-9)
            out.append(_row(r, start, np.array(r["mid"]), drawn(shape * scale, r["n"], _matrix(r["t_cov"]))))
    return pd.DataFrame(out, columns=NAMES)


def moments_of(pdf: pd.DataFrame, want: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the innermost ``want`` rows, from counts and moments by ascending bin."""
    n = pdf["n"].to_numpy(dtype=float)
    before = np.cumsum(n) - n
    share = np.clip((want - before) / n, 0, 1)
    mean = np.array([(pdf[f"s{i}"].to_numpy(dtype=float) * share).sum() for i in range(P)]) / want
    cov = np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = (pdf[f"p{i}{j}"].to_numpy(dtype=float) * share).sum() / want - mean[i] * mean[j]
    return mean, cov


def half_of(n: int) -> int:
    """Rows of which the determinant is taken."""
    return min(n, (n + P + 1) // 2)


def _next(trial: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Makes the next estimates of a group's starts; after the last trial only the best one's."""
    logdet, done = NAMES.index("logdet"), NAMES.index("done")

    def step(bins: pd.DataFrame, estimates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, e in estimates.iterrows():
            if e["done"]:
                out.append([*e[NAMES]])
                continue
            half = half_of(int(e["n"]))
            mean, cov = moments_of(bins[bins["start"] == e["start"]].sort_values("bin"), half)
            row = _row(e, e["start"], mean, drawn(consistency(half / e["n"]) * cov, e["n"], _matrix(e["t_cov"])))
            if trial > TRIALS and row[logdet] > e["logdet"] - LEAST_FALL:
                row = [*e[NAMES]]
                row[done] = True
            out.append(row)
        if trial >= TRIALS:
            out = [min(out, key=lambda r: r[logdet])]
        return pd.DataFrame(out, columns=NAMES)

    return step


def _final(pdf: pd.DataFrame, estimates: pd.DataFrame) -> pd.DataFrame:
    """A group's estimate over its rows within the CORE quantile; its mean, too, is drawn to the target's."""
    e = estimates.iloc[0]
    inner = pdf[pdf["bin"] == 0]
    count = float(inner["n"].sum())
    mean, cov = (moments_of(inner, count)) if count else (np.array(e["center"]), _matrix(e["cov"]))
    share = e["n"] / (e["n"] + PRIOR_ROWS)
    target = np.array(e["t_center"]) if len(e["t_center"]) else mean
    return pd.DataFrame([_row(e, 0, share * mean + (1 - share) * target, drawn(consistency(CORE) * cov, e["n"], _matrix(e["t_cov"])), True)], columns=NAMES)


def _distance() -> F.Column:
    """Squared Mahalanobis distance of x0.. from center."""
    d = [F.col(f"x{i}") - F.col("center")[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _by_bin(placed: DataFrame, bins: F.Column) -> DataFrame:
    moments = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    return placed.groupBy("g0", "g1", "start", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *moments)


def _advance(vectors: DataFrame, estimates: DataFrame, bins: F.Column, step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], small: bool) -> DataFrame:
    """All estimates, those that are not done after ``step`` on the counts and moments of their rows by bin.

    With few groups (``small``) the estimates are held on the driver; else they are a written table.
    """
    spark = vectors.sparkSession
    going = estimates.where(~F.col("done")).select("g0", "g1", "start", "center", "inverse")
    moved = _by_bin(_with_estimate(vectors, going, small), bins).groupBy("g0", "g1")
    if not small:
        return stage(moved.cogroup(estimates.toDF(*NAMES).groupBy("g0", "g1")).applyInPandas(step, ESTIMATE), "estimates")
    rows = [list(r) for r in estimates.collect()]
    held: dict[tuple, list] = {}
    for r in rows:
        held.setdefault((r[0], r[1]), []).append(r)
    shared = spark.sparkContext.broadcast(held)

    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf, pd.DataFrame(shared.value[key], columns=NAMES))

    new = [list(r) for r in moved.applyInPandas(of_group, ESTIMATE).collect()]
    return spark.createDataFrame([*new, *(r for r in rows if r[NAMES.index("done")])], ESTIMATE)


def estimate(vectors: DataFrame, targets: DataFrame) -> DataFrame:
    """Estimates of all groups (g0, g1) of ``vectors``; ``targets`` has g0, t_center (may be empty) and t_cov."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(f"x{i}").alias("v")) for i in range(P))))
    counted = vectors.select("g0", "g1", values.alias("e")).groupBy("g0", "g1", "e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    middle = cut(counted.groupBy("g0", "g1").applyInPandas(_middle, "g0 string, g1 string, mid array<double>, scale array<double>"))
    small = middle.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    z = [(F.col(f"x{i}") - F.col("mid")[i]) / F.col("scale")[i] for i in range(P)]
    length = F.greatest(F.sqrt(sum((x * x for x in z), F.lit(0.0))), F.lit(1e-9))
    # on a grid too, so that the sums do not depend on their order
    fine = {"s": [F.round(1024 * x / length).cast("long") for x in z], "t": [F.round(1024 * F.tanh(x)).cast("long") for x in z]}
    shapes = [(F.sum(c[i] * c[j]) / F.count(F.lit(1)) / 1024**2).alias(f"{k}{i}{j}") for k, c in fine.items() for i, j in PAIRS]
    rows = _with_estimate(vectors, middle, small).groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n"), F.first("mid").alias("mid"), F.first("scale").alias("scale"), *shapes)
    right = targets.withColumnRenamed("g0", "h0")
    named = rows.join(F.broadcast(right) if small else right, F.col("g0") == F.col("h0")).drop("h0")
    estimates = cut(named.mapInPandas(lambda parts: map(_starts, parts), ESTIMATE))
    for trial in range(1, STEPS + 1):
        bins = F.least(F.floor(BINS * F.log2(1 + F.greatest(_distance(), F.lit(0.0)))), F.lit(TOP_BIN)).cast("int")
        estimates = _advance(vectors, estimates, bins, _next(trial), small)
        if trial > TRIALS and estimates.where(~F.col("done")).isEmpty():
            break
    inner = F.when(_distance() <= chi2_quantile(CORE, P), 0).otherwise(1)
    out = cut(_advance(vectors, estimates.withColumn("done", F.lit(False)), inner, _final, small))
    release(vectors.sparkSession)
    return out


def _with_estimate(rows: DataFrame, estimates: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    right = estimates.withColumnsRenamed({"g0": "h0", "g1": "h1"})
    return rows.join(F.broadcast(right) if small else right, (F.col("g0") == F.col("h0")) & (F.col("g1") == F.col("h1")), how).drop("h0", "h1")


def measure(docs: DataFrame, text_column: str, carry: list[str]) -> DataFrame:
    """A struct ``row`` of the carried columns, STATS and MORE of every row."""
    ready = docs.select(packed(carry).alias("row"), F.col(text_column).alias("text"))
    kind = T.StructType([T.StructField("row", ready.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in STATS + MORE)])

    def each(batch: pa.RecordBatch):
        for part in runs(batch, 1):
            stats = [*zip(*map(base_stats, part.column(1).to_pylist()), strict=True)]
            yield table({"row": (part.column(0), None)} | {c: (v, pa.int64()) for c, v in zip(STATS + MORE, stats, strict=True)})

    return map_arrow(ready, each, kind)


def judge(docs: DataFrame, carry: list[str], text_column: str = "text", group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``row``, the statistics, ``base_failed`` and ``kept`` of every row."""
    both = docs.select(F.struct(packed(carry).alias("kept"), *(F.col(c).cast("string").alias(f"key{i}") for i, c in enumerate(group))).alias("mine"), F.col(text_column).alias("whole_text"))
    staged = stage(measure(both, "whole_text", ["mine"]), "quality")
    # a null key and an empty one are different groups
    keys = [F.coalesce(F.concat(F.lit("="), F.col(f"row.mine.key{i}")), F.lit("null")).alias(f"g{i}") for i in range(2)]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = staged.select("*", *keys, failed.alias("base_failed"))
    vectors = cut(rows.where(~F.col("base_failed")).select("g0", "g1", *_features()))
    prior = [[(GRID * PRIOR[i]) ** 2 if i == j else 0.0 for j in range(P)] for i in range(P)]
    given = [F.array().cast("array<double>").alias("t_center"), F.array(*(F.lit(v) for r in prior for v in r)).alias("t_cov")]
    languages = estimate(vectors.withColumn("g1", F.lit("")), vectors.select("g0").distinct().select("g0", *given))
    sources = estimate(vectors, languages.select("g0", F.col("center").alias("t_center"), F.col("cov").alias("t_cov")))
    small = sources.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    placed = _with_estimate(rows.select("*", *_features()), sources.select("g0", "g1", "center", "inverse"), small, "left")
    near = F.coalesce(_distance(), F.lit(0.0)) <= chi2_quantile(TAIL, P)
    return placed.select(F.col("row.mine.kept").alias("row"), *STATS, "base_failed", (~F.col("base_failed") & near).alias("kept"))


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document: its id, the statistics, base_failed and kept."""
    return judge(docs, [id_column]).select(F.col(f"row.{id_column}").alias(id_column), *STATS, "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    return judge(docs, docs.columns).where("kept").select("row.*")
