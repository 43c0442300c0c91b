"""The history buffer as a stateful stream: each input gives one output, itself or one that was stored before.

Until the pool is full, inputs are stored and returned. When it is full, with even chances (by a keyed hash of the row), a
stored row is returned and the input takes its place, or the input is returned. The state of a domain is one array of ids:
images stay in their own table. A domain's order is one sequence by nature; parallelism is over domains.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loomwright.functions.pixels import draw

OUTPUT = "domain string, seq long, image long, emitted long, replayed boolean"


def pool_step(pool: list[int], size: int, seed: int, domain: str, seq: int, image: int) -> int:
    """The image that is returned; changes pool."""
    if size == 0:
        return image
    if len(pool) < size:
        pool.append(image)
        return image
    if draw(seed, domain, seq, "swap") > 2**31:
        k = draw(seed, domain, seq, "which") % size
        pool[k], image = image, pool[k]
    return image


def fold(rows: Iterable[tuple[int, int]], size: int, seed: int, domain: str) -> list[int]:
    """What a pool returns for (seq, image) rows in order: the stream's result without a stream."""
    pool: list[int] = []
    return [pool_step(pool, size, seed, domain, s, i) for s, i in rows]


def image_pool(stream: DataFrame, size: int = 50, seed: int = 0) -> DataFrame:
    """The pool over a stream of (domain, seq, image). Rows of one micro-batch are taken in order of seq."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = [pool_step(pool, size, seed, key[0], int(s), int(i)) for s, i in zip(rows["seq"], rows["image"], strict=True)]
        state.update((pool,))
        yield pd.DataFrame({"domain": key[0], "seq": rows["seq"].to_numpy(), "image": rows["image"].to_numpy(), "emitted": out, "replayed": [o != i for o, i in zip(out, rows["image"], strict=True)]})

    return stream.groupBy("domain").applyInPandasWithState(run, OUTPUT, "pool array<long>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, spark: SparkSession, out: str) -> DataFrame:
    """Runs a stream over all that is there, into a Parquet table with its checkpoint beside it."""
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def log_losses(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch of loss records appended as formatted lines, as a running query."""
    from loomwright.sources.sinks import append_losses

    return stream.writeStream.foreachBatch(lambda df, _: append_losses(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
