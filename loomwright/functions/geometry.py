"""Size arithmetic of image transforms, as column expressions. Rounding is half to even where the values need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.operators.pairing import keyed_draw


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def round_even(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(x.cast("double"), 0).cast("long")


def multiple_of(size: Column, base: int = 4) -> Column:
    """The nearest multiple of base, halves to even multiples; small sizes become 0."""
    return round_even(size / base) * base


def size_note(w: Column, h: Column, base: int = 4) -> Column:
    """A warning for an image whose sides are no multiples of base; null for others. Its least one, if any, warns once for a table."""
    new_w, new_h = multiple_of(w, base), multiple_of(h, base)
    text = F.format_string(f"The image size needs to be a multiple of {base}. The loaded image size was (%d, %d), so it was adjusted to (%d, %d).", w, h, new_w, new_h)
    return F.when((new_w != w) | (new_h != h), text)


def resize(w: Column, h: Column, load: int, half_height: bool = False) -> tuple[Column, Column]:
    """A fixed size whatever the aspect; half_height halves the height."""
    return F.lit(load).cast("long"), F.lit(load // 2 if half_height else load).cast("long")


def scale_width(w: Column, h: Column, load: int, crop: int) -> tuple[Column, Column]:
    """Width load, height in proportion but at least crop; unchanged if the width fits and the height reaches crop."""
    same = (w == load) & (h >= crop)
    tall = F.greatest((_lit(load) * h / w).cast("double"), F.lit(float(crop))).cast("long")
    return F.when(same, w).otherwise(F.lit(load)).cast("long"), F.when(same, h).otherwise(tall).cast("long")


def scale_shortside(w: Column, h: Column, load: int) -> tuple[Column, Column]:
    """Enlarges so that the shorter side is load; never shrinks."""
    short = F.least(w, h)
    scale = F.lit(float(load)) / short
    keep = short >= load
    return F.when(keep, w).otherwise(round_even(w * scale)).cast("long"), F.when(keep, h).otherwise(round_even(h * scale)).cast("long")


def zoom(w: Column, h: Column, load: int, crop: int, factor_w: Column, factor_h: Column) -> tuple[Column, Column]:
    """load times each axis's factor, at least crop, rounded; w and h only give the type."""
    side = lambda f: round_even(F.greatest(F.lit(float(crop)), _lit(load) * f))
    return side(factor_w), side(factor_h)


def crop_box(w: Column, h: Column, size: int, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(left, top, right, bottom); the whole image unless it is larger along either axis."""
    larger = (w > size) | (h > size)
    return (*(F.when(larger, v).otherwise(F.lit(0)).cast("long") for v in (x, y)), F.when(larger, x + size).otherwise(w).cast("long"), F.when(larger, y + size).otherwise(h).cast("long"))


def trim_box(w: Column, h: Column, size: int, seed: Column) -> tuple[Column, Column, Column, Column]:
    """A keyed random window of at most size along each axis."""
    x = F.when(w > size, keyed_draw(seed, F.lit("x")) % (w - size + 1)).otherwise(F.lit(0)).cast("long")
    y = F.when(h > size, keyed_draw(seed, F.lit("y")) % (h - size + 1)).otherwise(F.lit(0)).cast("long")
    return x, y, F.least(x + size, w).cast("long"), F.least(y + size, h).cast("long")


def patch_grid(w: Column, h: Column, size: int, index: Column, seed: Column) -> tuple[Column, Column, Column, Column]:
    """Left and top of patch index modulo the number of patches, column by column; and columns, rows of the grid.

    The grid starts at a keyed random offset within what is left over.
    """
    nw, nh = F.floor(w / size).cast("long"), F.floor(h / size).cast("long")
    at = index % (nw * nh)
    ox = keyed_draw(seed, F.lit("x")) % (w - nw * size + 1)
    oy = keyed_draw(seed, F.lit("y")) % (h - nh * size + 1)
    return (ox + F.floor(at / nh) * size).cast("long"), (oy + at % nh * size).cast("long"), nw, nh


def params(w: Column, h: Column, load: int, crop: int, mode: str, seed: Column) -> tuple[Column, Column, Column]:
    """Crop offsets and flip for the size that the mode gives."""
    new_w, new_h = w, h
    if mode == "resize_and_crop":
        new_w = new_h = F.lit(load).cast("long")
    elif mode == "scale_width_and_crop":
        new_w, new_h = F.lit(load).cast("long"), F.floor(_lit(load) * h / w).cast("long")
    room = lambda s: F.greatest(F.lit(0), s - crop) + 1
    return (keyed_draw(seed, F.lit("x")) % room(new_w)).cast("long"), (keyed_draw(seed, F.lit("y")) % room(new_h)).cast("long"), keyed_draw(seed, F.lit("flip")) >= 2**31


def expand_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, share: float = 0.25) -> tuple[Column, Column, Column, Column]:
    """A box grown by a share of its sides in all directions, cut to whole pixels and to the image."""
    left, top = F.greatest((x - w * share).cast("long"), F.lit(0)), F.greatest((y - h * share).cast("long"), F.lit(0))
    return left.cast("long"), top.cast("long"), F.least((x + w + w * share).cast("long"), width).cast("long"), F.least((y + h + h * share).cast("long"), height).cast("long")


def grid_rows(n: Column, columns: int) -> tuple[Column, Column]:
    """Rows of a display grid, and the white images that fill it."""
    rows = F.ceil(n / columns).cast("long")
    return rows, (rows * columns - n).cast("long")


def load_size(load: int, crop: int, epoch: Column, n_epochs: int, train: bool) -> Column:
    """In fine-tuning epochs of training, images are loaded at the crop size."""
    return F.when(F.lit(train) & (epoch > n_epochs), F.lit(crop)).otherwise(F.lit(load))


def power_of_two(x: Column) -> Column:
    """2 to the rounded binary logarithm."""
    return F.pow(F.lit(2.0), F.rint(F.log2(x))).cast("long")
