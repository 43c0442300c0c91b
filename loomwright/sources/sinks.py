"""Sinks: image files, side-by-side pairs, HTML pages and loss logs."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.pixels import array_of, encode_png, resize
from loomwright.functions.text import loss_line


def stretch(img: np.ndarray, aspect: float) -> np.ndarray:
    """Resized for an aspect ratio other than 1: over 1 along the width, under 1 along the height."""
    h, w = img.shape[:2]
    if aspect > 1:
        return resize(img, int(w * aspect), h)
    return resize(img, w, int(h / aspect)) if aspect < 1 else img


def write_images(images: DataFrame, root: str, name: str = "name", aspect: float = 1.0) -> DataFrame:
    """Writes each row's image as <root>/<name>.png through the path's file system; returns (name, bytes) when read.

    Only file sizes come back, and a task that runs again writes the same files again.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            names, sizes = b.column("name").to_pylist(), []
            for n, *x in zip(names, *(b.column(c).to_pylist() for c in ("height", "width", "channels", "data")), strict=True):
                blob, path = encode_png(stretch(array_of(*x), aspect)), f"{base}/{n}.png"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(blob)
                sizes.append(len(blob))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return images.select(F.col(name).alias("name"), "height", "width", "channels", "data").mapInArrow(run, "name string, bytes long")


def fan_out(visuals: DataFrame) -> DataFrame:
    """Names <label>/<stem> for visuals (label, path, image columns): one file for each."""
    from loomwright.functions.text import stem

    return visuals.withColumn("name", F.concat("label", F.lit("/"), stem(F.col("path"))))


def side_by_side(pairs: DataFrame) -> DataFrame:
    """(name, image columns) of pairs (name, a, b: image structs of one height): a left of b."""

    def run(batches):
        for b in batches:
            both = [np.concatenate([array_of(*(x[k] for k in ("height", "width", "channels", "data"))) for x in ab], axis=1) for ab in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), *(pa.array([i.shape[k] for i in both], pa.int32()) for k in range(3)), pa.array([i.tobytes() for i in both], pa.binary())], names=["name", "height", "width", "channels", "data"])

    return pairs.select("name", "a", "b").mapInArrow(run, "name string, height int, width int, channels int, data binary")


def html_page(title: str, sections: Iterator[tuple[str, list[tuple[str, str]]]], width: int = 256, refresh: int = 0) -> str:
    """A page with one table of linked thumbnails for each (header, [(label, file name)]) section."""
    parts = ["<!DOCTYPE html>", "<html>", "<head>", f"<title>{html.escape(title)}</title>"]
    if refresh:
        parts.append(f'<meta http-equiv="refresh" content="{refresh}">')
    parts += ["</head>", "<body>"]
    for header, files in sections:
        parts.append(f"<h3>{html.escape(header)}</h3>")
        cells = "".join(f'<td style="word-wrap: break-word; text-align: center"><a href="images/{html.escape(f)}"><img style="width:{width}px" src="images/{html.escape(f)}"></a><br><p>{html.escape(label)}</p></td>' for label, f in files)
        parts.append(f'<table border="1" style="table-layout: fixed"><tr>{cells}</tr></table>')
    return "\n".join([*parts, "</body>", "</html>", ""])


def write_index(written: DataFrame, path: str, title: str, width: int = 256) -> str:
    """The index page of written visuals (path, label, name), a section for each source path, in order."""
    rows = written.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("label", "name"))).alias("files")).orderBy("path")
    sections = ((r["path"], [(f["label"], f["name"] + ".png") for f in r["files"]]) for r in rows.toLocalIterator())
    return _write_text(html_page(title, sections, width), path)


def epoch_page(epochs: int, labels: list[str], path: str, title: str) -> str:
    """The training page: epochs from the newest to the first, with the image of each label."""
    sections = ((f"epoch [{n}]", [(x, f"epoch{n:03d}_{x}.png") for x in labels]) for n in range(epochs, 0, -1))
    return _write_text(html_page(title, sections, refresh=0), path)


def _write_text(text: str, path: str) -> str:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(base) as f:
        f.write(text.encode())
    return path


def append_losses(records: DataFrame, path: str) -> None:
    """Appends (epoch, iters, compute, data, losses) as lines of text, in order of epoch and iters within each append."""
    line = loss_line(F.col("epoch"), F.col("iters"), F.col("compute"), F.col("data"), F.col("losses"))
    records.orderBy("epoch", "iters").select(line.alias("value")).write.mode("append").text(path)


def loss_series(records: DataFrame, names: list[str]) -> DataFrame:
    """(x, one column for each name) from (epoch, fraction, name, value), x = epoch + fraction."""
    wide = records.groupBy((F.col("epoch") + F.col("fraction")).alias("x")).pivot("name", names).agg(F.first("value"))
    return wide.orderBy("x")
