"""Normalisations, pooling, statistics and moving averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import dense_position


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))


def l2_normalise(feat: Column, eps: float = 1e-7) -> Column:
    """x / (norm + eps)."""
    norm = F.sqrt(_sum(feat, lambda x: x * x))
    return F.transform(feat, lambda x: x.cast("double") / (norm + eps))


def pixel_norm(feat: Column, eps: float = 1e-8) -> Column:
    """x / sqrt(mean of squares + eps) over the channels of one place."""
    scale = F.sqrt(_sum(feat, lambda x: x * x) / F.size(feat) + eps)
    return F.transform(feat, lambda x: x.cast("double") / scale)


def standardise(df: DataFrame, by: list[str], value: str, eps: float, sample: bool = False, eps_inside: bool = True, out: str = "normed") -> DataFrame:
    """(x - mean) / deviation within groups. sample: n - 1; eps_inside: added to the variance, else to the deviation.

    Instance norm: by image and channel, population, inside (1e-5). Layer norm: by image, sample, outside. Grouped channel
    norm: by image, place and group, sample, outside (1e-7). Batch norm: by channel.
    """
    x = F.col(value).cast("double")
    stats = df.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.avg(x).alias("__mean"), (F.var_samp(x) if sample else F.var_pop(x)).alias("__var"))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    scale = F.sqrt(F.col("__var") + eps) if eps_inside else F.sqrt("__var") + eps
    return df.join(stats, same).withColumn(out, (x - F.col("__mean")) / scale).select(*df.columns, out)


def demodulation(weights: DataFrame, by: list[str], value: str, eps: float = 1e-8) -> DataFrame:
    """1 / sqrt(sum of squared weights + eps) for each sample and output channel."""
    return weights.groupBy(*by).agg((F.lit(1.0) / F.sqrt(F.sum(F.pow(F.col(value).cast("double"), F.lit(2.0))) + eps)).alias("scale"))


def moving_average(values: Column, keep: float, start: Column | None = None) -> Column:
    """Exponential moving average of an ordered array: keep * average + (1 - keep) * value, seeded by start or the first."""
    first = F.element_at(values, 1).cast("double") if start is None else start
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))) if start is None else values
    return F.aggregate(rest, first, lambda s, x: s * keep + x.cast("double") * (1 - keep))


def ema_by(df: DataFrame, by: list[str], order: str, value: str, keep: float, start: float | None) -> DataFrame:
    """The final moving average of each group's values in order, as a weighted sum: no group is collected.

    With r rows after it, a value weighs (1 - keep) * keep^r; the seed weighs keep^n.
    """
    placed = dense_position(df.select(*by, F.col(order).alias("__o"), F.col(value).cast("double").alias("__x")), [*by, F.desc("__o")], "__p")
    starts = placed.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min("__p").alias("__first"))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    rows = placed.join(starts, same).select(*by, "__x", (F.col("__p") - F.col("__first")).alias("__r"))
    n = F.count(F.lit(1))
    fresh = F.sum((1 - keep) * F.col("__x") * F.pow(F.lit(keep), F.col("__r")))
    if start is None:
        first = F.max_by("__x", "__r")
        return rows.groupBy(*by).agg((fresh + first * F.pow(F.lit(keep), n)).alias("ema"))
    return rows.groupBy(*by).agg((fresh + F.lit(start) * F.pow(F.lit(keep), n)).alias("ema"))


def global_max_pool(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(value).alias("pooled"))


def adaptive_bins(df: DataFrame, place: str, size: Column, bins: int) -> DataFrame:
    """One row for each bin that a place is in: bin b covers floor(b * size / bins) to ceil((b + 1) * size / bins)."""
    b = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    rows = df.withColumn("bin", b)
    return rows.filter((F.col(place) >= F.floor(F.col("bin") * size / bins)) & (F.col(place) < F.ceil((F.col("bin") + 1) * size / bins)))


def exact_median(df: DataFrame, value: str) -> float | None:
    """By place in a range-sorted table, nulls left out: only the one or two middle rows are collected."""
    rows = dense_position(df.select(F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull()), ["x"])
    n = rows.count()
    return rows.filter(F.col("pos").isin([(n - 1) // 2, n // 2])).agg(F.avg("x").alias("m")).first()["m"] if n else None


def array_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, least, greatest, exact median and population deviation."""
    x = F.col(value).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.lit(exact_median(df, value)).cast("double").alias("median"), F.stddev_pop(x).alias("std"))


def normalise_channels(df: DataFrame, by: list[str], value: str, eps: float = 1e-7, out: str = "normed") -> DataFrame:
    """L2 over the rows of each group (channels of a place): x / (norm + eps). For pooled features, which are rows."""
    norms = df.groupBy(*by).agg(F.sqrt(F.sum(F.pow(F.col(value).cast("double"), F.lit(2.0)))).alias("__norm"))
    return df.join(norms, by).withColumn(out, F.col(value) / (F.col("__norm") + eps)).drop("__norm")


def pool_2d(df: DataFrame, by: list[str], y: str, x: str, height: Column, width: Column, value: str, bins: int) -> DataFrame:
    """Adaptive average pool to bins x bins: by, bin_y, bin_x, pooled."""
    rows = adaptive_bins(adaptive_bins(df, y, height, bins).withColumnRenamed("bin", "bin_y"), x, width, bins).withColumnRenamed("bin", "bin_x")
    return rows.groupBy(*by, "bin_y", "bin_x").agg(F.avg(F.col(value).cast("double")).alias("pooled"))


def minibatch_stddev(df: DataFrame, slot: list[str], feature: list[str], value: str, eps: float = 1e-8) -> DataFrame:
    """slot, stddev: deviation of each feature over a slot's group members, averaged over the features."""
    each = df.groupBy(*slot, *feature).agg(F.sqrt(F.var_pop(F.col(value).cast("double")) + eps).alias("__d"))
    return each.groupBy(*slot).agg(F.avg("__d").alias("stddev"))


#: Steps whose decayed sums are kept in one window, so that 1 / keep^steps stays small.
EMA_BLOCK = 4096


def subtract_moving_average(df: DataFrame, by: list[str], step: str, value: str, keep: float = 0.999, out: str = "rest") -> DataFrame:
    """x minus the moving average up to and with it, of each series of by in order of step (0, 1, 2, ... without gaps).

    The average starts as the first value; later ones enter with weight 1 - keep. Steps are summed in blocks of EMA_BLOCK; a fold over
    a series' blocks carries the average from block to block.
    """
    x, block, t = F.col(value).cast("double"), F.floor(F.col(step) / EMA_BLOCK).cast("long"), F.col(step) % EMA_BLOCK
    weight = F.when(F.col(step) == 0, F.lit(1.0)).otherwise(F.lit(1 - keep))
    rows = df.withColumns({"__b": block, "__t": t, "__x": x})
    own = Window.partitionBy(*by, "__b").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum(weight * F.col("__x") * F.pow(F.lit(1 / keep), F.col("__t"))).over(own) * F.pow(F.lit(keep), F.col("__t")))
    ends = rows.groupBy(*by, "__b").agg(F.max_by("__own", "__t").alias("own"), F.max("__t").alias("t"))
    blocks = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("__b").alias("b"), "own", "t"))).alias("ends"))
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<b:bigint,carry:double>>").alias("all"))
    fold = lambda acc, e: F.struct((acc["at"] * F.pow(F.lit(keep), e["t"] + 1) + e["own"]).alias("at"), F.concat(acc["all"], F.array(F.struct(e["b"].alias("b"), acc["at"].alias("carry")))).alias("all"))
    carried = blocks.select(*by, F.inline(F.aggregate("ends", start, fold, lambda acc: acc["all"])).alias("__b", "__carry"))
    average = F.col("__own") + F.col("__carry") * F.pow(F.lit(keep), F.col("__t") + 1)
    return rows.join(carried, [*by, "__b"]).withColumn(out, F.col("__x") - average).select(*df.columns, out)


def mean_abs_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean over groups of the mean absolute value in each group."""
    each = df.groupBy(by).agg(F.avg(F.abs(F.col(value).cast("double"))).alias("g"))
    return each.agg(F.avg("g").alias("mean_abs"), F.count(F.lit(1)).alias("n_groups"))


def parameter_counts(params: DataFrame) -> DataFrame:
    """Millions of numbers of each network. params: net, shape."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda s, x: s * x)
    return params.groupBy("net").agg((F.sum(size) / 1e6).alias("millions"))


def mean_vector(df: DataFrame, by: list[str], feat: str) -> DataFrame:
    """Average for each dimension."""
    each = df.select(*by, F.posexplode(feat).alias("dim", "x"))
    return each.groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
