"""Weights of networks as tables: one Parquet folder for each network and epoch.

A row is a parameter: (param, shape, data), data in row-major order. What is read is as large as the model, not as the data.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomwright.functions.networks import Weights
from loomwright.sources.images import exists

SCHEMA = "param string, shape array<int>, data array<double>"


def folder(root: str, epoch: int | str, net: str) -> str:
    """<root>/<epoch>_net_<net>; epoch is a number or "latest"."""
    return f"{root.rstrip('/')}/{epoch}_net_{net}"


def save_weights(spark: SparkSession, nets: Mapping[str, Weights], root: str, epoch: int | str = "latest") -> None:
    """Writes each network's weights; those of the same epoch are replaced."""
    for net, weights in nets.items():
        rows = [(k, [int(n) for n in np.shape(w)], np.asarray(w, np.float64).ravel().tolist()) for k, w in sorted(weights.items())]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder(root, epoch, net))


def weight_table(spark: SparkSession, root: str, net: str, epoch: int | str = "latest") -> DataFrame:
    """(param, shape, data) of a network. A network that was not saved raises."""
    path = folder(root, epoch, net)
    if not exists(spark, path):
        raise FileNotFoundError(f"no weights at {path}")
    return spark.read.schema(SCHEMA).parquet(path)


def load_weights(spark: SparkSession, root: str, nets: list[str], epoch: int | str = "latest", pretrained: str | None = None) -> dict[str, dict[str, np.ndarray]]:
    """Weights of the networks by name, from another experiment's folder if pretrained is given."""
    tables = {net: weight_table(spark, pretrained or root, net, epoch).collect() for net in nets}
    return {net: {r["param"]: np.array(r["data"], np.float64).reshape(r["shape"]) for r in rows} for net, rows in tables.items()}
