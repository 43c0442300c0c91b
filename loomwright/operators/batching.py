"""Order, limits, batches, samples and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import dense_position, keyed_draw, keyed_order, prefix_sums


def sorted_limit(df: DataFrame, order: list[Column | str], limit: int | None) -> DataFrame:
    """The first rows in order; None: all. Sorting comes before the limit, so which rows stay is defined."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def epoch_shuffle(df: DataFrame, key: str, seed: int, epoch: int, serial: bool = False) -> DataFrame:
    """Adds place: the row's position in the epoch's order; by key if serial."""
    return dense_position(df, [key] if serial else [keyed_order(F.lit(seed), F.lit(epoch), F.col(key)), key], "place")


def batches(df: DataFrame, size: int, drop_last: bool, place: str = "place") -> DataFrame:
    """Adds batch_id; drop_last drops a last batch that is not full."""
    out = df.withColumn("batch_id", F.floor(F.col(place) / size).cast("long"))
    if not drop_last:
        return out
    full = df.count() // size
    return out.filter(F.col("batch_id") < full)


def limit_batches(df: DataFrame, size: int, most: int | None) -> DataFrame:
    """Whole batches that start before `most` rows."""
    return df if most is None else df.filter(F.col("batch_id") * size < most)


def sample_patches(df: DataFrame, layer: str, place: str, n: int, seed: int) -> DataFrame:
    """Of each layer n places without replacement, the same for all its images; n = 0 keeps all."""
    if n == 0:
        return df
    draw = df.select(layer, place).distinct()
    rank = F.row_number().over(Window.partitionBy(layer).orderBy(keyed_order(F.lit(seed), F.col(layer), F.col(place)), place))
    chosen = draw.withColumn("patch_id", rank.cast("long") - 1).filter(F.col("patch_id") < n)
    return df.join(chosen, [layer, place])


def zoom_table(rows: DataFrame, index: str, batch_size: int, most: float, seed: int) -> DataFrame:
    """Adds zoom_w and zoom_h, uniform in [1 / most, 1], equal within a batch."""
    batch = F.floor(F.col(index) / batch_size).cast("long")
    low = 1 / most
    return rows.withColumns({f"zoom_{k}": F.lit(low) + F.lit(1 - low) * keyed_draw(F.lit(seed), F.lit(k), batch) / F.lit(float(2**32)) for k in ("w", "h")})


def every(total: str, n: int) -> Column:
    """Whether a trigger fires: the running total is a multiple of n."""
    return F.col(total) % n == 0


def running_totals(df: DataFrame, order: list[str], size: str, partition: list[str] | None = None) -> DataFrame:
    """Adds total_iters over all rows before and with this one, and epoch_iter within each partition (the epoch).

    Epochs follow each other in the order of their columns. Totals are two-level prefix sums: no epoch meets in one task.
    """
    rows = prefix_sums(df, [*(partition or []), *order], size, "total_iters")
    if not partition:
        return rows.withColumn("epoch_iter", F.col("total_iters"))
    sums = df.groupBy(*partition).agg(F.sum(size).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*partition).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums.select(*partition, before.alias("__before")), partition).withColumn("epoch_iter", F.col("total_iters") - F.col("__before")).drop("__before")


def flip_batches(df: DataFrame, index: str, batch_size: int, seed: int, training: bool = True) -> DataFrame:
    """Adds flipped: in training, a batch is flipped as a whole, with even chances by a keyed draw."""
    batch = F.floor(F.col(index) / batch_size).cast("long")
    return df.withColumn("flipped", (keyed_draw(F.lit(seed), F.lit("flip"), batch) < F.lit(2**31)) & F.lit(training))


def flip_rows(feature: Column, flipped: Column) -> Column:
    """A row of places, reversed where its batch is flipped: before encoding, and again on the features to undo it."""
    return F.when(flipped, F.reverse(feature)).otherwise(feature)


def panes(index: Column, per_window: int) -> tuple[Column, Column]:
    """Window and pane of an experiment's index."""
    return F.floor(index / per_window).cast("long"), (index % per_window).cast("long")
