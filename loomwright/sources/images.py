"""Image scans: listings, decoding to RGB, and the layouts of one and two domains.

Listings read paths alone (the content column is pruned) and are sorted before any limit. Pixels are decoded after
limits and pairing, by Spark's image source; PPM, which it cannot read, by a parser of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.pixels import IMAGE, array_of, decode_ppm, grayscale
from loomwright.functions.text import SUFFIXES, basename, paired_name
from loomwright.operators.pairing import dense_position

#: Rows that the single-image layout pretends to have.
VIRTUAL_ROWS = 100_000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_images(spark: SparkSession, root: str, limit: int | None = None, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = True) -> DataFrame:
    """(pos, path) of the image files below root, sorted by path; the first `limit` of them. A missing root raises."""
    if not exists(spark, root):
        raise FileNotFoundError(f"{root} is not a valid directory")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root).select("path")
    files = files if limit is None else files.orderBy("path").limit(limit)
    return dense_position(files, ["path"])


def list_flat(spark: SparkSession, root: str) -> DataFrame:
    """(pos, path) of lower-case .png and .jpg files directly in root."""
    return list_images(spark, root, suffixes=(".png", ".jpg"), recursive=False)


def list_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """(pos, path) of the files that a glob matches."""
    return dense_position(spark.read.format("binaryFile").load(pattern).select("path"), ["path"])


def list_splits(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """(split, name, path) of files in root's subdirectories; of each split the first `most` by name."""
    from pyspark.sql import Window

    rows = spark.read.format("binaryFile").load(f"{root}/*/*").select("path")
    rows = rows.select(F.element_at(F.split("path", "/"), -2).alias("split"), basename(F.col("path")).alias("name"), "path")
    if most is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("split").orderBy("name"))).filter(F.col("__n") <= most).drop("__n")


def sibling_pairs(a: DataFrame, b: DataFrame, suffix_mode: bool = False) -> DataFrame:
    """(split, name, path_a, path_b): files of two trees with one split and name; with suffix_mode a's "_A." files match "_B." ones."""
    left = a.withColumnRenamed("path", "path_a")
    right = b.withColumnRenamed("path", "path_b")
    if suffix_mode:
        left = left.filter(F.col("name").contains("_A.")).withColumn("__match", paired_name(F.col("name")))
        joined = left.join(right.withColumnRenamed("name", "__match"), ["split", "__match"])
        return joined.select("split", paired_name(F.col("name"), ".").alias("name"), "path_a", "path_b")
    return left.join(right, ["split", "name"]).select("split", "name", "path_a", "path_b")


def to_rgb(img: np.ndarray) -> np.ndarray:
    """From Spark's interleaved BGR, gray or BGRA."""
    if img.shape[2] == 1:
        return np.repeat(img, 3, axis=2)
    return np.ascontiguousarray(img[..., 2::-1])


#: Paths that are handed to a reader one by one; of more files, the reader gets their folders.
MOST_PATHS = 10_000


def read_images(files: DataFrame, gray: bool = False) -> DataFrame:
    """(path, height, width, channels, data): RGB pixels of the listed files (column path). An unreadable file raises.

    The driver sees at most MOST_PATHS paths; of longer lists it sees the folders, whose scan is joined with the list by path.
    """
    spark = files.sparkSession
    wanted = files.select("path").distinct()
    is_ppm = F.lower("path").endswith(".ppm")

    def sources(part: DataFrame) -> tuple[list[str], bool]:
        few = [r["path"] for r in part.limit(MOST_PATHS + 1).collect()]
        return (few, False) if len(few) <= MOST_PATHS else ([r["d"] for r in part.select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct().collect()], True)

    def listed(scan: DataFrame, folders: bool) -> DataFrame:
        plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")  # noqa: E731  readers differ in slashes
        return scan.join(wanted.select(plain("path").alias("wanted")), plain("path") == F.col("wanted"), "left_semi") if folders else scan

    (ppms, ppm_folders), (rest, rest_folders) = sources(wanted.filter(is_ppm)), sources(wanted.filter(~is_ppm))
    if not ppms and not rest:
        return spark.createDataFrame([], f"path string, {IMAGE}")
    raw = listed(spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][pP][mM]").load(ppms).select("path", "content"), ppm_folders) if ppms else None

    def rows(keys, images):
        images = [grayscale(x) if gray else x for x in images]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([x.shape[k] for x in images], pa.int32()) for k in range(3)), pa.array([x.tobytes() for x in images], pa.binary())], names=["path", "height", "width", "channels", "data"])

    def native(batches):
        for b in batches:
            keys, h, w, c, data = (b.column(k).to_pylist() for k in ("path", "height", "width", "nChannels", "data"))
            if bad := [k for k, x in zip(keys, h, strict=True) if x < 0]:
                raise ValueError(f"not an image: {bad[0]}")
            yield rows(keys, [to_rgb(array_of(*x)) for x in zip(h, w, c, data, strict=True)])

    def ppm(batches):
        for b in batches:
            images = [decode_ppm(x) for x in b.column("content").to_pylist()]
            yield rows(b.column("path").to_pylist(), [np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x for x in images])

    out = None
    if rest:
        img = listed(spark.read.format("image").load(rest).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data"), rest_folders)
        out = img.mapInArrow(native, f"path string, {IMAGE}")
    if raw is not None:
        more = raw.mapInArrow(ppm, f"path string, {IMAGE}")
        out = more if out is None else out.unionByName(more)
    return out


def scan_tree(spark: SparkSession, root: str, gray: bool = False) -> DataFrame:
    """All images below root, decoded where they lie: the form for large trees, without a list of paths on the driver."""

    def rows(batches):
        for b in batches:
            keys, h, w, c, data = (b.column(k).to_pylist() for k in ("path", "height", "width", "nChannels", "data"))
            if bad := [k for k, x in zip(keys, h, strict=True) if x < 0]:
                raise ValueError(f"not an image: {bad[0]}")
            images = [to_rgb(array_of(*x)) for x in zip(h, w, c, data, strict=True)]
            images = [grayscale(x) if gray else x for x in images]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([x.shape[k] for x in images], pa.int32()) for k in range(3)), pa.array([x.tobytes() for x in images], pa.binary())], names=["path", "height", "width", "channels", "data"])

    globs = "*{" + ",".join(s for s in SUFFIXES if "ppm" not in s.lower()) + "}"
    img = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(root)
    return img.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(rows, f"path string, {IMAGE}")


def two_domains(spark: SparkSession, root: str, phase: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Listings of <root>/<phase>A and <phase>B; a test phase without testA takes valA and valB."""
    if phase == "test" and not exists(spark, f"{root}/testA") and exists(spark, f"{root}/valA"):
        phase = "val"
    return tuple(list_images(spark, f"{root}/{phase}{side}", limit) for side in "AB")


def one_domain(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    return list_images(spark, root, limit)


def single_images(spark: SparkSession, root: str, rows: int = VIRTUAL_ROWS) -> DataFrame:
    """(i, path_a, path_b) of the only image of trainA and of trainB, `rows` times. More or fewer files raise."""
    a, b = two_domains(spark, root, "train")
    for side, files in (("A", a), ("B", b)):
        if (n := files.count()) != 1:
            raise ValueError(f"train{side} must hold exactly one image, not {n}")
    one = a.select("pos", F.col("path").alias("path_a")).join(b.select("pos", F.col("path").alias("path_b")), "pos").drop("pos")
    first = one.first()
    return spark.range(rows).select(F.col("id").alias("i"), F.lit(first["path_a"]).alias("path_a"), F.lit(first["path_b"]).alias("path_b"))


#: Dataset modes: name to a function of (spark, root, phase, limit). Options that a mode adds: name to its defaults.
MODES: dict[str, Callable] = {}
MODE_OPTIONS: dict[str, dict] = {}


def dataset(name: str, **options):
    """Registers a dataset mode, with the options that it adds or overrides."""

    def wrap(f):
        key = name.replace("_", "").lower()
        MODES[key], MODE_OPTIONS[key] = f, options
        return f

    return wrap


def find_dataset(name: str) -> Callable:
    """By mode name, without regard to underscores and case; unknown names raise."""
    try:
        return MODES[name.replace("_", "").lower()]
    except KeyError:
        raise NotImplementedError(f"no dataset mode {name}; known: {', '.join(sorted(MODES))}") from None


dataset("unaligned")(two_domains)
dataset("single")(lambda spark, root, phase, limit=None: one_domain(spark, root, limit))
dataset("singleimage")(lambda spark, root, phase, limit=None: single_images(spark, root))
