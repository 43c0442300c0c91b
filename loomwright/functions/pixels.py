"""Pixel transforms on arrays of height x width x channels in 8 bits, and their pipeline over image rows.

Sizes come from loomwright.functions.geometry's rules, draws from keyed hashes, so that a row's result depends on its key, the seed
and the epoch alone. Rows are decoded and transformed in Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

IMAGE = "height int, width int, channels int, data binary"


def draw(*parts) -> int:
    """The same keyed draw as loomwright.operators.pairing.keyed_draw."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def round_even(x: float) -> int:
    return int(np.rint(x))


def _kernel_cubic(x: np.ndarray) -> np.ndarray:
    """Cubic convolution with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


def _weights(old: int, new: int) -> np.ndarray:
    """(new, old) matrix of resampling weights; the kernel widens when shrinking."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    w = _kernel_cubic((np.arange(old)[None, :] + 0.5 - centre[:, None]) / wide)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int, method: str = "bicubic") -> np.ndarray:
    """To the given size. A side of 0 gives an empty image."""
    h, w = img.shape[:2]
    if (w, h) == (width, height):
        return img
    if not width or not height:
        return np.zeros((height, width, img.shape[2]), np.uint8)
    if method == "nearest":
        return img[np.minimum(((np.arange(height) + 0.5) * h / height).astype(int), h - 1)][:, np.minimum(((np.arange(width) + 0.5) * w / width).astype(int), w - 1)]
    out = np.einsum("yh,hwc->ywc", _weights(h, height), img.astype(np.float64))
    out = np.clip(np.floor(out + 0.5), 0, 255) if h != height else out
    out = np.einsum("xw,ywc->yxc", _weights(w, width), out)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def grayscale(img: np.ndarray) -> np.ndarray:
    """One channel: luma of red, green, blue, in the usual integer weights."""
    if img.shape[2] == 1:
        return img
    r, g, b = (img[..., k].astype(np.uint32) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)[..., None]


def crop(img: np.ndarray, x: int, y: int, size: int) -> np.ndarray:
    """A square at (x, y) if the image is larger along either axis; parts outside are black."""
    h, w = img.shape[:2]
    if w <= size and h <= size:
        return img
    out = np.zeros((size, size, img.shape[2]), np.uint8)
    part = img[max(y, 0) : y + size, max(x, 0) : x + size]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def multiple_of_four(img: np.ndarray) -> np.ndarray:
    h, w = img.shape[:2]
    return resize(img, round_even(w / 4) * 4, round_even(h / 4) * 4)


def flip(img: np.ndarray) -> np.ndarray:
    return img[:, ::-1]


def to_tensor(img: np.ndarray) -> np.ndarray:
    """Channels first, in [-1, 1]."""
    return (img.astype(np.float32).transpose(2, 0, 1) / np.float32(255) - np.float32(0.5)) / np.float32(0.5)


def to_image(tensor: np.ndarray) -> np.ndarray:
    """Back to 8 bits: clamped, one channel tripled, fractions cut off."""
    t = np.clip(tensor, -1, 1)
    t = np.repeat(t, 3, axis=0) if t.shape[0] == 1 else t
    return ((t.transpose(1, 2, 0) + 1) / 2 * 255).astype(np.uint8)


def tiles(tensor: np.ndarray, size: int) -> np.ndarray:
    """(rows * columns, channels, size, size) of channels x height x width; sides must be multiples of size."""
    c, h, w = tensor.shape
    if h % size or w % size:
        raise ValueError("sides must be multiples of the tile size")
    return tensor.reshape(c, h // size, size, w // size, size).transpose(1, 3, 0, 2, 4).reshape(-1, c, size, size)


@dataclass(frozen=True)
class Transform:
    """The steps named in `preprocess` (by substring), in their fixed order. fixed: size for "fixsize"."""

    preprocess: str = "resize_and_crop"
    load_size: int = 286
    crop_size: int = 256
    gray: bool = False
    half_height: bool = False
    no_flip: bool = False
    fixed: tuple[int, int] = (256, 256)
    seed: int = 0

    def __call__(self, img: np.ndarray, key, patch_index: int = 0) -> np.ndarray:
        pick = lambda what, n: draw(self.seed, key, what) % n
        p, load, size = self.preprocess, self.load_size, self.crop_size
        if self.gray:
            img = grayscale(img)
        h, w = img.shape[:2]
        if "fixsize" in p:
            img = resize(img, *self.fixed)
        if "resize" in p:
            img = resize(img, load, load // 2 if self.half_height else load)
        elif "scale_width" in p:
            img = img if w == load and h >= size else resize(img, load, int(max(load * h / w, size)))
        elif "scale_shortside" in p and min(w, h) < load:
            img = resize(img, round_even(w * load / min(w, h)), round_even(h * load / min(w, h)))
        if "zoom" in p:
            level = [0.8 + 0.2 * draw(self.seed, key, a) / 2**32 for a in ("zoom_w", "zoom_h")]
            img = resize(img, round_even(max(size, load * level[0])), round_even(max(size, load * level[1])))
        h, w = img.shape[:2]
        if "crop" in p:
            img = crop(img, pick("x", max(1, w - size + 1)), pick("y", max(1, h - size + 1)), size)
        if "patch" in p:
            nw, nh = w // size, h // size
            at, ox, oy = patch_index % (nw * nh), pick("px", w - nw * size + 1), pick("py", h - nh * size + 1)
            x, y = ox + at // nh * size, oy + at % nh * size
            img = img[y : y + size, x : x + size]
        if "trim" in p:
            h, w = img.shape[:2]
            x, y = (pick("tx", w - size + 1) if w > size else 0), (pick("ty", h - size + 1) if h > size else 0)
            img = img[y : y + size, x : x + size]
        img = multiple_of_four(img)
        if not self.no_flip and draw(self.seed, key, "flip") >= 2**31:
            img = flip(img)
        return np.ascontiguousarray(img)


def array_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def transform_images(images: DataFrame, transform: Transform, key: str = "path") -> DataFrame:
    """Images (key, height, width, channels, data) transformed, each by draws of its own key."""

    def run(batches):
        for b in batches:
            keys = b.column(key).to_pylist()
            done = [transform(array_of(*x), k) for k, *x in zip(keys, *(b.column(c).to_pylist() for c in ("height", "width", "channels", "data")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([i.shape[k] for i in done], pa.int32()) for k in range(3)), pa.array([i.tobytes() for i in done], pa.binary())], names=[key, "height", "width", "channels", "data"])

    return images.select(key, "height", "width", "channels", "data").mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, {IMAGE}")


def tensors(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, c, h, w, data array<float>) in [-1, 1]."""

    def run(batches):
        for b in batches:
            done = [to_tensor(array_of(*x)) for x in zip(*(b.column(c).to_pylist() for c in ("height", "width", "channels", "data")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([t.shape[k] for t in done], pa.int32()) for k in range(3)), pa.array([t.ravel() for t in done], pa.list_(pa.float32()))], names=[key, "c", "h", "w", "data"])

    return images.select(key, "height", "width", "channels", "data").mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, c int, h int, w int, data array<float>")


def encode_png(img: np.ndarray) -> bytes:
    """A PNG of 1 or 3 channels, rows unfiltered."""
    h, w, c = img.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * c)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_ppm(blob: bytes) -> np.ndarray:
    """Binary PPM and PGM with 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while blob[at : at + 1].isspace():
            at += 1
        if blob[at : at + 1] == b"#":
            at = blob.index(b"\n", at)
            continue
        end = at
        while end < len(blob) and not blob[end : end + 1].isspace():
            end += 1
        fields.append(blob[at:end])
        at = end
    kind, w, h, top = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or top > 255:
        raise ValueError("not an 8-bit binary PPM or PGM")
    c = 3 if kind == b"P6" else 1
    return np.frombuffer(blob, np.uint8, h * w * c, at + 1).reshape(h, w, c)
