"""Page images: decoding, preparing, cutting, and what columns of pixels say about borders.

Images come as PNG (eight bits, not interlaced) or portable grey- and
pixmaps, and are worked on as arrays of grey values, each by one task; what
comes out are images again or small relations for ``profiles``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .providers import image_hash

#: Share of white pixels from which a crop is blank; grey values above this are white.
BLANK, WHITE = 0.95, 240
#: Parts of a page or title block to read, as fractions x0, y0, x1, y1: edges of a title block, the strips of a page that hold one, a page's edges.
STRIPS = {
    "block_right": (0.70, 0.0, 1.0, 1.0), "block_left": (0.0, 0.0, 0.30, 1.0), "wide_right": (0.85, 0.0, 1.0, 1.0), "vertical_right": (0.92, 0.0, 1.0, 1.0),
    "edge_right": (0.95, 0.0, 1.0, 1.0), "edge_left": (0.0, 0.0, 0.05, 1.0), "corner": (0.85, 0.85, 1.0, 1.0), "edge_right_wider": (0.90, 0.0, 1.0, 1.0),
}


class ImageError(ValueError):
    """An image that can't be read."""


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey values of rows of pixels with one to four channels; alpha is laid over white."""
    if pixels.ndim == 2:
        return pixels.astype(np.uint8)
    p = pixels.astype(np.float64)
    n = p.shape[2]
    value = p[:, :, :3] @ (0.299, 0.587, 0.114) if n >= 3 else p[:, :, 0]
    if n in (2, 4):
        alpha = p[:, :, -1] / 255
        value = value * alpha + 255 * (1 - alpha)
    return np.clip(np.rint(value), 0, 255).astype(np.uint8)


def _png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[2] != 8 or head[6]:
        raise ImageError("only PNG of eight bits, not interlaced")
    width, height, _, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            by = line.reshape(width, channels)
            line = np.cumsum(by, axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind in (3, 4):
            for i in range(len(line)):
                left = int(line[i - channels]) if i >= channels else 0
                up, corner = int(above[i]), int(above[i - channels]) if i >= channels else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    near = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                    guess = (left, up, corner)[near.index(min(near))]
                line[i] = (int(line[i]) + guess) & 255
        out[y] = above = line
    pixels = out.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if colour == 3 and palette is not None else pixels


def decode(data: bytes) -> np.ndarray:
    """Grey values of an image, rows first."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return grey(_png(data))
        m = re.match(rb"P([56])\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s", data)
        if m and int(m[4]) == 255:
            w, h, n = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
            return grey(np.frombuffer(data, np.uint8, w * h * n, m.end()).reshape(h, w, n))
    except (ValueError, KeyError, IndexError, zlib.error, struct.error) as e:
        raise ImageError(str(e)) from e
    raise ImageError("neither PNG nor a portable map")


def encode(values: np.ndarray) -> bytes:
    """Grey values as PNG."""
    h, w = values.shape
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    rows = np.hstack([np.zeros((h, 1), np.uint8), values.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def best_threshold(values: np.ndarray) -> int:
    """The grey value that splits an image into two groups with the most between them."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (total / below - (total[-1] - total) / above) ** 2)
    return int(between.argmax())


def prepared(values: np.ndarray, least_height: int = 0) -> np.ndarray:
    """Black on white for reading: dark images inverted, small ones enlarged, split at the best threshold."""
    out = 255 - values if values.mean() < 127 else values
    if least_height and out.shape[0] < least_height:
        k = -(-least_height // out.shape[0])
        out = out.repeat(k, axis=0).repeat(k, axis=1)
    return np.where(out > best_threshold(out), 255, 0).astype(np.uint8)


def cropped(values: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of an image between fractions of its width and height, whole pixels cut off."""
    h, w = values.shape
    x0, y0, x1, y1 = (int(v * s) for v, s in zip(box, (w, h, w, h), strict=True))
    return values[y0:y1, x0:x1]


def edges(values: np.ndarray) -> np.ndarray:
    """How much each pixel differs from its eight neighbours, 0 at the rim."""
    v = values.astype(np.int32)
    out = np.zeros_like(v)
    if min(v.shape) > 2:
        around = sum(np.roll(np.roll(v, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1))
        out[1:-1, 1:-1] = np.clip(9 * v - around, 0, 255)[1:-1, 1:-1]
    return out.astype(np.uint8)


def longest_runs(mask: np.ndarray) -> np.ndarray:
    """The longest vertical run of each column."""
    best = run = np.zeros(mask.shape[1], np.int64)
    for row in mask:
        run = np.where(row, run + 1, 0)
        best = np.maximum(best, run)
    return best


def largest_part(mask: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """(pixels, x0, y0, x1, y1) of the largest part of set pixels that touch, also at corners; null if none is set."""
    parent: list[int] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    runs: list[tuple[int, int, int, int]] = []  # part, row, start, stop
    before: list[tuple[int, int, int, int]] = []
    for y, row in enumerate(mask):
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            for other, _, c, d in before:
                if c <= b and a <= d:
                    parent[find(other)] = find(k)
            now.append((k, y, a, b))
        runs += now
        before = now
    parts: dict[int, list[int]] = {}
    for k, y, a, b in runs:
        p = parts.setdefault(find(k), [0, a, y, b - 1, y])
        p[0] += b - a
        p[1], p[2], p[3], p[4] = min(p[1], a), min(p[2], y), max(p[3], b - 1), max(p[4], y)
    return tuple(max(parts.values(), key=lambda p: (p[0], -p[2], -p[1]))) if parts else None


def _images(pages: DataFrame, *more: Column) -> DataFrame:
    """Distinct images, with the columns that say what to do with them."""
    d = pages.where("image is not null").select(image_hash(F.col("image")).alias("image_hash"), "image", *more)
    return d.dropDuplicates([c for c in d.columns if c != "image"])


def image_facts(pages: DataFrame) -> DataFrame:
    """(image_hash, width, height, mean, white, blank, error) of distinct images; an image that can't be read has an error."""
    schema = pa.schema([("image_hash", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mean", pa.float64()), ("white", pa.float64()), ("blank", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    v = decode(image.as_py())
                    white = float((v >= WHITE).mean()) if v.size else 1.0
                    rows.append({"image_hash": h, "width": v.shape[1], "height": v.shape[0], "mean": float(v.mean()), "white": white, "blank": white >= BLANK, "error": None})
                except ImageError as e:
                    rows.append({"image_hash": h, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _images(pages).mapInArrow(run, "image_hash string, width int, height int, mean double, white double, blank boolean, error string")


def _changed(rows: DataFrame, change: Callable[..., np.ndarray]) -> DataFrame:
    """Images made from (image_hash, image, what): (image_hash, what, image), null for one that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for image, what in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                try:
                    made.append(encode(change(decode(image.as_py()), what)))
                except ImageError:
                    made.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.binary())], names=["image_hash", "what", "image"])

    kind = rows.schema["what"].dataType.simpleString()
    return rows.mapInArrow(run, f"image_hash string, what {kind}, image binary")


def prepare(pages: DataFrame, least_height: int = 0) -> DataFrame:
    """(image_hash, image): distinct images ready to be read."""
    return _changed(_images(pages).withColumn("what", F.lit(least_height)), lambda v, h: prepared(v, h)).drop("what")


def turn(pages: DataFrame) -> DataFrame:
    """(image_hash, angle, image): images turned against the clock by ``angle``, a multiple of 90."""
    return _changed(_images(pages, F.col("angle").cast("int").alias("what")), lambda v, a: np.rot90(v, (a or 0) // 90)).withColumnRenamed("what", "angle")


def crop(pages: DataFrame, strips: dict[str, tuple[float, float, float, float]] = STRIPS) -> DataFrame:
    """(image_hash, strip, image): the named parts of each distinct image."""
    named = F.explode(F.array(*[F.lit(k) for k in strips]))
    return _changed(_images(pages).withColumn("what", named), lambda v, k: cropped(v, strips[k])).withColumnRenamed("what", "strip")


def column_profiles(pages: DataFrame, threshold: int = 25) -> DataFrame:
    """(id, x, v, run): edge pixels and the longest vertical run of them in each column of an image; id is the image's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    mask = edges(decode(image.as_py())) > threshold
                except ImageError:
                    continue
                n = mask.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([h] * n), pa.array(range(n), pa.int32()), pa.array(mask.sum(axis=0), pa.int64()), pa.array(longest_runs(mask), pa.int64())], names=["id", "x", "v", "run"])

    return _images(pages).mapInArrow(run, "id string, x int, v long, run long")


def main_parts(pages: DataFrame, threshold: int = 25) -> DataFrame:
    """(id, pixels, x0, y0, x1, y1) of the largest connected part of an image's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "pixels", "x0", "y0", "x1", "y1"]
        for b in batches:
            rows = []
            for h, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    part = largest_part(edges(decode(image.as_py())) > threshold)
                except ImageError:
                    part = None
                if part:
                    rows.append((h, *part))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)]], names=names)

    return _images(pages).mapInArrow(run, "id string, pixels long, x0 long, y0 long, x1 long, y1 long")


def deskew_angle(segments: DataFrame, most: float = 5.0, least: int = 5) -> DataFrame:
    """(page, angle): the median angle of a page's flat lines, 0 if there are fewer than ``least`` or it is more than ``most`` degrees.

    ``segments``: page, x1, y1, x2, y2.
    """
    a = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    d = segments.withColumn("a", a).groupBy("page").agg(F.median(F.when(F.abs("a") < 45, F.col("a"))).alias("m"), F.count_if(F.abs("a") < 45).alias("n"))
    return d.select("page", F.when((F.col("n") >= least) & (F.abs("m") <= most), F.col("m")).otherwise(0.0).alias("angle"))
