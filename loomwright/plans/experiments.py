"""Experiment commands as rows: common options expanded by runs, selected, rendered, named and laid out in panes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import common_prefix, grab, render_options
from loomwright.operators.batching import panes
from loomwright.operators.pairing import prefix_sums


def merge(base: Column, over: Column, removed: Column | None = None) -> Column:
    """Maps merged, the later one winning; then names removed."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    out = F.map_concat(kept, over)
    return out if removed is None else F.map_filter(out, lambda k, _: ~F.array_contains(removed, k))


def commands(spark: SparkSession, launcher: str, common: dict[str, str], runs: list[dict[str, str]], phases: tuple[str, ...] = ("train", "test"), removed: tuple[str, ...] = ()) -> DataFrame:
    """(launcher, id, phase, options, command): each run's options over the common ones, for each phase.

    A run's value None removes an option.
    """
    rows = [(launcher, i, {k: v for k, v in r.items() if v is not None}, [k for k, v in r.items() if v is None] + list(removed)) for i, r in enumerate(runs)]
    df = spark.createDataFrame(rows, "launcher string, id long, own map<string,string>, gone array<string>")
    base = F.create_map(*(F.lit(x) for kv in common.items() for x in kv)).cast("map<string,string>") if common else F.create_map().cast("map<string,string>")
    full = df.select("launcher", "id", F.explode(F.array(*map(F.lit, phases))).alias("phase"), merge(base, F.col("own"), F.col("gone")).alias("options"))
    return full.withColumn("command", F.concat(F.lit("python "), "phase", F.lit(".py"), render_options(F.col("options"))))


def select(rows: DataFrame, ids: list[int] | None) -> DataFrame:
    """The commands of the ids; None: all."""
    return rows if ids is None else rows.filter(F.col("id").isin(ids))


def layout(rows: DataFrame, per_window: int) -> DataFrame:
    """Adds win and pane of each command by its id."""
    w, p = panes(F.col("id"), per_window)
    return rows.withColumns({"win": w, "pane": p})


def on_devices(rows: DataFrame, free: list[str]) -> DataFrame:
    """Commands (id, command) with devices: each takes as many as its --gpu_ids names (1 without), in order of id, from the free ones.

    The devices are put before the command. A command for which too few are left raises when read.
    """
    wanted = F.size(F.split(F.coalesce(grab(F.col("command"), r"--gpu_ids ([\d,]+)"), F.lit("0")), ","))
    taken = prefix_sums(rows.withColumn("__n", wanted), ["id"], "__n", "__upto")
    short = F.raise_error(F.concat(F.col("__n").cast("string"), F.lit(" device(s) required for "), "command")).cast("array<string>")
    given = F.when(F.col("__upto") > len(free), short).otherwise(F.slice(F.array(*map(F.lit, free)).cast("array<string>"), (F.col("__upto") - F.col("__n") + 1).cast("int"), F.col("__n")))
    out = taken.withColumn("devices", F.array_join(given, ",")).drop("__n", "__upto")
    return out.withColumn("command", F.concat(F.lit("CUDA_VISIBLE_DEVICES="), "devices", F.lit(" "), "command"))


def names(rows: DataFrame) -> DataFrame:
    """(id, phase, name, epoch, label, results): what comparison pages need; epoch defaults to latest, label to the name."""
    c = F.col("command")
    out = rows.select("id", "phase", grab(c, r"--name ([^\s]+)").alias("name"), F.coalesce(grab(c, r"--epoch ([^\s]+)"), F.lit("latest")).alias("epoch"), grab(c, r"--easy_label ([^\s]+)").alias("label"))
    return out.select("id", "phase", "name", "epoch", F.coalesce("label", "name").alias("label"), F.format_string("./results/%s/test_%s/", F.col("name"), F.col("epoch")).alias("results"))


def shared_start(rows: DataFrame) -> DataFrame:
    """(shared): how much of the names' common start a comparison page leaves out. The set of one launcher's names is small."""
    return rows.agg(F.collect_set("name").alias("all")).select(common_prefix(F.col("all")).alias("shared"))
