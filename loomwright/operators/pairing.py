"""Pairing of two collections by position, by chance and by name; direction and tagged unions.

Positions are explicit columns. Dense positions come from a two-level rank: a range shuffle sorts the keys, each partition
counts its rows, and only the partition counts are summed up, so no task sees a whole collection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.plans.session import durable


def dense_position(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """Adds the row's place (from 0) in the given order, which should be total.

    The sort is a range shuffle, kept so that its partitions stay as they are; each numbers its rows, and a window over
    one row per partition gives the offsets.
    """
    sorted_rows = durable(df.orderBy(*order)).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id() % (1 << 33))
    sizes = sorted_rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return sorted_rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def prefix_sums(df: DataFrame, order: Sequence[Column | str], value: str, name: str = "upto") -> DataFrame:
    """Adds the sum of value over all rows up to this one in the given order, which should be total.

    As dense_position: each sorted partition sums its rows, and a window over one row per partition gives the offsets.
    """
    sorted_rows = durable(df.orderBy(*order)).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    own = F.sum(value).over(Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sorted_rows.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return sorted_rows.withColumn("__own", own).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__row", "__own", "__before")


def keyed_draw(*parts: Column | str) -> Column:
    """A reproducible draw in [0, 2^32) from the parts: the first 8 hex digits of their md5."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def keyed_order(*parts: Column | str) -> Column:
    """A reproducible shuffle key: md5 of the parts."""
    return F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def _count(df: DataFrame) -> int:
    n = df.count()
    if n == 0:
        raise ValueError("pairing needs rows on both sides")
    return n


def pair_modulo(a: DataFrame, b: DataFrame, position: str = "pos") -> DataFrame:
    """Row i of max(|a|, |b|) pairs a[i mod |a|] with b[i mod |b|]. Columns get the suffixes _a and _b. Empty sides raise."""
    n_a, n_b = _count(a), _count(b)
    left = a.select(*(F.col(c).alias(f"{c}_a") for c in a.columns))
    right = b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))
    rows = a.sparkSession.range(max(n_a, n_b)).withColumnRenamed("id", "i")
    return rows.join(left, F.col("i") % n_a == F.col(f"{position}_a")).join(right, F.col("i") % n_b == F.col(f"{position}_b"))


def pair_random(a: DataFrame, b: DataFrame, seed: int, epoch: int, position: str = "pos") -> DataFrame:
    """As pair_modulo for a; b is drawn with replacement, anew each epoch, by a keyed hash."""
    n_a, n_b = _count(a), _count(b)
    left = a.select(*(F.col(c).alias(f"{c}_a") for c in a.columns))
    right = b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))
    rows = a.sparkSession.range(max(n_a, n_b)).withColumnRenamed("id", "i").withColumn("__draw", keyed_draw(F.lit(seed), F.lit(epoch), F.col("i")) % n_b)
    return rows.join(left, F.col("i") % n_a == F.col(f"{position}_a")).join(right, F.col("__draw") == F.col(f"{position}_b")).drop("__draw")


def zip_join(a: DataFrame, b: DataFrame, position: str = "pos", strict: bool = True) -> DataFrame:
    """Rows of equal position. strict: the sides must be of one length, or it raises."""
    if strict and a.count() != b.count():
        raise ValueError("zip_join needs sides of one length")
    return a.join(b, position)


def name_orphans(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has; side is a or b. Null keys match nothing."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    one = left.join(right, key, "left_anti").withColumn("side", F.lit("a"))
    return one.unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("b")))


def check_name_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join by a natural key; a key without a partner, on either side, raises when read."""
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full")
    missing = F.raise_error(F.concat(F.lit("no partner for "), F.coalesce(F.col(key).cast("string"), F.lit("a null key")))).cast("boolean")
    return both.filter(F.coalesce(F.col("__a") & F.col("__b"), missing)).drop("__a", "__b")


def both_exist(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose keys also exist in b."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def swap_direction(df: DataFrame, names: Sequence[tuple[str, str]], a_to_b: bool) -> DataFrame:
    """Exchanges the paired columns unless the direction is a to b."""
    if a_to_b:
        return df
    other = {x: y for a, b in names for x, y in ((a, b), (b, a))}
    return df.select(*(F.col(other.get(c, c)).alias(c) for c in df.columns))


def tagged_union(**sides: DataFrame) -> DataFrame:
    """Bag union with the side's name in src, so that it can be split again without positions."""
    out = None
    for name, df in sides.items():
        tagged = df.withColumn("src", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def broadcast_scalar(df: DataFrame, **values: float) -> DataFrame:
    """One value for each row: labels of real and fake."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def tile_concat(grid: DataFrame, style: DataFrame, key: str, feature: str = "feat", vector: str = "style") -> DataFrame:
    """A style vector appended to each place's feature of the same image."""
    return grid.join(style, key).withColumn(feature, F.concat(feature, vector)).drop(vector)
