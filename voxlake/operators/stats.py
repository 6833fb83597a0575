"""Density statistics; unset values are SQL nulls here and the format's sentinels in files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.session import ship

#: What a header says when a statistic is not set.
SENTINELS = (0.0, -1.0, -2.0, -1.0)
TOLERANCE = 0.01


def density_stats(value: Column) -> list[Column]:
    """n, dmin, dmax, dmean and rms (population deviation). NaN is left out of the extremes and spreads into mean and rms."""
    d = value.cast("double")
    number = F.when(~F.isnan(d), d)
    return [F.count(value).alias("n"), F.min(number).alias("dmin"), F.max(number).alias("dmax"), F.avg(d).alias("dmean"), F.stddev_pop(d).alias("rms")]


def complex_stats(re: Column, im: Column) -> list[Column]:
    """n, unset extremes and mean, and the rms of complex voxels: root of the summed variances of the parts."""
    unset = [F.lit(v).alias(c) for v, c in zip(SENTINELS, ("dmin", "dmax", "dmean"), strict=False)]
    rms = F.sqrt(F.var_pop(re.cast("double")) + F.var_pop(im.cast("double")))
    return [F.count(re).alias("n"), *unset, F.coalesce(rms, F.lit(-1.0)).alias("rms")]


def with_sentinels(stats: DataFrame) -> DataFrame:
    """Nulls as the format writes them."""
    return stats.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(("dmin", "dmax", "dmean", "rms"), SENTINELS, strict=True)})


def nonfinite_counts(*parts: Column) -> list[Column]:
    """Counts of NaN, +Inf and -Inf over all parts (one, or two for complex voxels), and their share in percent."""
    parts_d = [p.cast("double") for p in parts]
    count = lambda test: sum((F.count_if(test(p)) for p in parts_d), F.lit(0).cast("long"))
    nan, up, down = count(F.isnan), count(lambda p: p == float("inf")), count(lambda p: p == float("-inf"))
    total = sum((F.count(p) for p in parts_d), F.lit(0).cast("long"))
    share = F.when(total > 0, 100.0 * (nan + up + down) / total).otherwise(F.lit(0.0))
    return [nan.alias("n_nan"), up.alias("n_pinf"), down.alias("n_ninf"), share.alias("pct")]


def is_close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal, or within the tolerance of the larger magnitude."""
    return (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def claims_hold(claimed: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Compare claimed with actual statistics; an unset claim holds. ``complex`` rows claim the rms only."""
    c, a = claimed.alias("c"), actual.alias("a")
    joined = c.join(a, keys)
    unset = F.col("c.dmin") > F.col("c.dmax")
    skip = unset | F.coalesce(F.col("c.complex"), F.lit(False)) if "complex" in claimed.columns else unset
    ok = [(skip | is_close(F.col(f"c.{n}"), F.col(f"a.{n}"))).alias(o) for n, o in (("dmin", "min_ok"), ("dmax", "max_ok"), ("dmean", "mean_ok"))]
    return joined.select(*keys, *ok, ((F.col("c.rms") < 0) | is_close(F.col("c.rms"), F.col("a.rms"))).alias("rms_ok"))


Moments = tuple[int, float, float, float, float]


def moments(values: np.ndarray) -> Moments:
    """Number, least, largest, mean and squared deviations; NaN is left out of the extremes only."""
    c = values.astype(np.float64).ravel()
    if not len(c):
        return 0, float("inf"), float("-inf"), 0.0, 0.0
    known = c[~np.isnan(c)]
    low, high = (float(known.min()), float(known.max())) if len(known) else (float("inf"), float("-inf"))
    mean = float(c.mean())
    return len(c), low, high, mean, float(((c - mean) ** 2).sum())


def merge_moments(parts: list[Moments]) -> Moments:
    """Merge (n, min, max, mean, M2) of parts (Chan's formula); for the writer's commit."""
    n, low, high, mean, m2 = 0, float("inf"), float("-inf"), 0.0, 0.0
    for k, a, b, mu, s in parts:
        if not k:
            continue
        both = n + k
        delta = mu - mean
        m2 += s + delta * delta * n * k / both
        mean += delta * k / both
        low, high, n = min(low, a), max(high, b), both
    return n, low, high, mean, m2


def block_mean(data: Column) -> Column:
    """Mean of a block's array, without exploding it."""
    return F.aggregate(data, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(data)


def block_moments(blocks: DataFrame) -> DataFrame:
    """(path, first, n, low, high, mean, m2): the moments of each file's voxels that a task reads, from block rows of numbers."""
    ship(blocks.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            data = batch.column(2)
            for i, (path, oz) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                mine = moments(np.asarray(data[i].values))
                found[path] = [min(found[path][0], oz), merge_moments([found[path][1], mine])] if path in found else [oz, mine]
        rows = [(p, z, *m) for p, (z, m) in found.items()]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "first", "n", "low", "high", "mean", "m2"])

    return blocks.select("path", "oz", "data").mapInArrow(each, "path string, first int, n long, low double, high double, mean double, m2 double")


def merged_stats(parts: DataFrame) -> DataFrame:
    """(path, n, dmin, dmax, dmean, rms) from the moments of parts, one row of each task and file (Chan's formula)."""

    def merge(s: Column, x: Column) -> Column:
        n = s["n"] + x["n"]
        delta, whole = x["mean"] - s["mean"], F.greatest(n, F.lit(1))
        mean = s["mean"] + delta * x["n"] / whole
        m2 = s["m2"] + x["m2"] + delta * delta * s["n"] * x["n"] / whole
        return F.struct(n.alias("n"), F.least(s["low"], x["low"]).alias("low"), F.greatest(s["high"], x["high"]).alias("high"), mean.alias("mean"), m2.alias("m2"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    listed = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first", "n", "low", "high", "mean", "m2"))).alias("parts"))
    m = listed.select("path", F.aggregate("parts", zero, merge).alias("m"))
    some = F.col("m.low") <= F.col("m.high")
    full = F.col("m.n") > 0
    return m.select("path", F.col("m.n").alias("n"), F.when(some, F.col("m.low")).alias("dmin"), F.when(some, F.col("m.high")).alias("dmax"), F.when(full, F.col("m.mean")).alias("dmean"), F.when(full, F.sqrt(F.col("m.m2") / F.col("m.n"))).alias("rms"))
