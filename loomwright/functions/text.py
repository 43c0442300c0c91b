"""Names, options and patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for true and false, and the image suffixes (exact case).
TRUE, FALSE = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")
SUFFIXES = tuple(s for x in ("jpg", "jpeg", "png", "ppm", "bmp", "tif", "tiff") for s in (f".{x}", f".{x.upper()}"))


def parse_bool(text: Column) -> Column:
    """A truth word in any case; anything else raises."""
    low = F.lower(text)
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("Boolean value expected: "), text)).cast("boolean"))


def class_key(name: Column) -> Column:
    """Plug-in names compare without underscores and case."""
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The basename without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def is_image(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def grab(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def common_prefix(texts: Column, less: int = 4, least: int = 1) -> Column:
    """Length of the common start of an array of strings, reduced by less, at least `least`."""
    first = F.element_at(texts, 1)
    shortest = F.array_min(F.transform(texts, lambda t: F.length(t)))
    agree = F.filter(F.sequence(F.lit(0), shortest), lambda n: F.forall(texts, lambda t: F.substring(t, F.lit(1), n) == F.substring(first, F.lit(1), n)))
    return F.greatest(F.array_max(agree) - less, F.lit(least)).cast("long")


def int_list(text: Column) -> Column:
    """Comma-separated whole numbers."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int"))


def render_options(options: Column) -> Column:
    """" --key value" for each entry of a map, by key; a null or empty value gives the key alone."""
    entries = F.array_sort(F.map_entries(options))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(" --"), e["key"], F.when(F.coalesce(e["value"], F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), e["value"])))), "")


def paired_name(path: Column, to: str = "_B.") -> Column:
    """The partner's name of a "..._A." file; to="." drops the mark."""
    return F.replace(path, F.lit("_A."), F.lit(to))


def loss_line(epoch: Column, iters: Column, compute: Column, data: Column, losses: Column) -> Column:
    """One log line: header, then each "name: value" with three decimals. losses: array of (name, value) in order."""
    head = F.format_string("(epoch: %d, iters: %d, time: %.3f, data: %.3f) ", epoch, iters, compute, data)
    return F.concat(head, F.array_join(F.transform(losses, lambda x: F.format_string("%s: %.3f ", x["name"], x["value"])), ""))


def option_line(key: Column, value: Column, default: Column) -> Column:
    """An option and, if it differs, its default."""
    note = F.when(value.eqNullSafe(default), F.lit("")).otherwise(F.concat(F.lit("\t[default: "), F.coalesce(default, F.lit("None")), F.lit("]")))
    return F.concat(F.lpad(key, 25, " "), F.lit(": "), F.rpad(F.coalesce(value, F.lit("None")), 30, " "), note)
