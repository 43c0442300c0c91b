"""Learning-rate schedules, filter kernels and activations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(epoch: Column, epoch_count: int, n_epochs: int, n_decay: int) -> Column:
    """1 until n_epochs, then straight down to 0 one epoch after the last."""
    return F.lit(1.0) - F.greatest(F.lit(0), epoch + epoch_count - n_epochs) / F.lit(float(n_decay + 1))


def step(epoch: Column, every: int, gamma: float = 0.1) -> Column:
    return F.pow(F.lit(gamma), F.floor(epoch / every).cast("double"))


def cosine(epoch: Column, n_epochs: int, least: float = 0.0) -> Column:
    """Share of the first rate by cosine annealing."""
    return F.lit(least) + (1 - least) * (F.lit(1.0) + F.cos(F.lit(math.pi) * epoch / n_epochs)) / 2


def plateau(metrics: Column, rate: float, factor: float = 0.2, patience: int = 5, threshold: float = 0.01) -> Column:
    """The rate after an ordered array of metrics: cut by factor after more than patience epochs without a lower value.

    Lower means under (1 - threshold) of the best so far.
    """
    start = F.struct(F.lit(rate).alias("rate"), F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"))

    def fold(s, x):
        better = x < s["best"] * (1 - threshold)
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        cut = bad > patience
        return F.struct(F.when(cut, s["rate"] * factor).otherwise(s["rate"]).alias("rate"), F.when(better, x).otherwise(s["best"]).alias("best"), F.when(cut, F.lit(0)).otherwise(bad).alias("bad"))

    return F.aggregate(metrics, start, fold, lambda s: s["rate"])


def binomial_kernel(size: int) -> np.ndarray:
    """Outer product of the binomial coefficients of size - 1, summing to 1."""
    if not 1 <= size <= 7:
        raise ValueError("kernel sizes are 1 to 7")
    row = np.array([math.comb(size - 1, k) for k in range(size)], float)
    out = np.outer(row, row)
    return out / out.sum()


def leaky_relu(x: Column, slope: float = 0.2, gain: float = math.sqrt(2)) -> Column:
    return F.when(x > 0, x).otherwise(x * slope) * gain
