"""Image headers, pixels and features of pixels, without an imaging library."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = "struct<width: int, height: int>"
HASH_SIDE, LOW_SIDE = 32, 8
#: shortest side after resizing, side of the centre crop
SHORT, CROP = 256, 224
#: channel means and deviations of the usual normalisation (fixed values)
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG, BMP or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        kind = struct.unpack("<I", data[14:18])[0]
        if kind == 12:
            return struct.unpack("<HH", data[18:22])
        if kind >= 40:
            w, h = struct.unpack("<ii", data[18:26])
            return (w, abs(h)) if w > 0 and h else None
        return None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill bytes
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD9:  # markers without a segment
            at += 2
        else:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                if at + 9 > len(data):
                    return None
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def _sizes(content: pd.Series) -> pd.DataFrame:
    found = [header_size(bytes(c)) if c is not None else None for c in content]
    ok = [x if x and x[0] > 0 and x[1] > 0 else (None, None) for x in found]
    return pd.DataFrame({"width": pd.array([x[0] for x in ok], "Int32"), "height": pd.array([x[1] for x in ok], "Int32")})


def dimensions(content: Column) -> Column:
    """``width, height`` of image bytes, null where the header tells none."""
    d = F.pandas_udf(_sizes, DIMS)(content)
    return F.when(d["width"].isNotNull(), d)


def orientation(data: bytes) -> int:
    """EXIF orientation (1 to 8) of a JPEG; 1 where it tells none."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
            return _tiff_orientation(data[at + 10 : at + 2 + size])
        if marker == 0xDA or size < 2:
            return 1
        at += 2 + size
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        if order is None or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
            return 1
        at = struct.unpack_from(order + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if tag == 0x0112 and kind == 3:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        return 1
    return 1


def upright(pixels: np.ndarray, way: int) -> np.ndarray:
    """Pixels turned and mirrored as an EXIF orientation asks."""
    if way in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if way in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if way in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, height, width, channels, data`` as decoded by Spark's image source; undecodable files have height -1."""
    rows = spark.read.format("image").load(path)
    cols = [F.col("image.origin").alias("file_path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"]
    return rows.select(*cols)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_pixels``, but upright by EXIF and as BGR, with ``known_format``: whether the header is that of an image.

    Decoded pixels and headers are read in one pass each and meet by path.
    """

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                h, w, data = r.height, r.width, r.data
                if h > 0 and r.way > 1:
                    p = upright(np.frombuffer(data, np.uint8).reshape(h, w, r.channels), r.way)
                    h, w, data = p.shape[0], p.shape[1], np.ascontiguousarray(p).tobytes()
                out.append((r.file_path, h, w, r.channels, data, r.known_format))
            yield pd.DataFrame(out, columns=["file_path", "height", "width", "channels", "data", "known_format"])

    headers = spark.read.format("binaryFile").load(path).select(plain("path"), _header(F.col("content")).alias("head"))
    headers = headers.select("file_path", F.col("head.way").alias("way"), F.col("head.known").alias("known_format"))
    pixels = read_pixels(spark, path).withColumn("file_path", plain("file_path"))
    both = pixels.join(headers, "file_path")
    schema = "file_path string, height int, width int, channels int, data binary, known_format boolean"
    return both.select("file_path", "height", "width", "channels", "data", "way", "known_format").mapInPandas(turned, schema)


def plain(column: str) -> Column:
    """A local path without its scheme, as ``file_path``."""
    return F.regexp_replace(column, "^file:/+", "/").alias("file_path")


def _header(content: Column) -> Column:
    def read(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"way": [orientation(bytes(c)) for c in data], "known": [header_size(bytes(c)) is not None for c in data]})

    return F.pandas_udf(read, "struct<way: int, known: boolean>")(content)


def rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def resize(a: np.ndarray, height: int, width: int, cubic: bool = True) -> np.ndarray:
    """Antialiased separable resampling (bicubic with a = -0.5, or bilinear)."""

    def kernel(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        if not cubic:
            return np.maximum(0.0, 1 - x)
        return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))

    def matrix(n: int, m: int) -> np.ndarray:
        scale = n / m
        stretch = max(scale, 1.0)
        centre = (np.arange(m) + 0.5) * scale
        w = kernel((np.arange(n)[None, :] + 0.5 - centre[:, None]) / stretch)
        return w / w.sum(1, keepdims=True)

    a = a.astype(float)
    return np.einsum("ij,jk...->ik...", matrix(a.shape[0], height), np.einsum("kj,ij...->ik...", matrix(a.shape[1], width), a))


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits of the low 8 x 8 block of the orthonormal 2-D DCT of the grey 32 x 32 image, against the median without DC."""
    grey = np.round(pixels[..., :3] @ np.array([0.299, 0.587, 0.114])) if pixels.ndim == 3 else pixels
    small = np.clip(np.round(resize(grey, HASH_SIDE, HASH_SIDE)), 0, 255)
    n = np.arange(HASH_SIDE)
    basis = np.sqrt(2 / HASH_SIDE) * np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / (2 * HASH_SIDE))
    basis[0] /= np.sqrt(2)
    low = (basis @ small @ basis.T)[:LOW_SIDE, :LOW_SIDE].reshape(-1)
    bits = low >= np.median(low[1:])
    return int("".join("1" if b else "0" for b in bits), 2)


def hash_dataset(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """``image_id, file_path, hash, failure_code`` of every image: missing_path, missing_image, image_decode_error, hash_calculation_error."""
    done = hash_images(pixels).withColumnRenamed("file_path", "at")
    code = F.when(F.col("file_path").isNull(), "missing_path").when(F.col("at").isNull(), "missing_image").otherwise(F.col("failure_code"))
    named = images.select("image_id", "file_path", F.regexp_replace("file_path", "^file:/+", "/").alias("path"))
    joined = named.join(done.withColumn("at", F.regexp_replace("at", "^file:/+", "/")), F.col("path") == F.col("at"), "left")
    return joined.select("image_id", "file_path", "hash", code.alias("failure_code"))


def hash_images(pixels: DataFrame) -> DataFrame:
    """``file_path, hash, failure_code`` of decoded images."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.height <= 0:
                    out.append((r.file_path, None, "image_decode_error"))
                else:
                    try:
                        h = perceptual_hash(rgb(r.height, r.width, r.channels, r.data))
                        out.append((r.file_path, h - (1 << 64) if h >> 63 else h, None))
                    except ValueError:
                        out.append((r.file_path, None, "hash_calculation_error"))
            yield pd.DataFrame({"file_path": [x[0] for x in out], "hash": pd.array([x[1] for x in out], "Int64"), "failure_code": [x[2] for x in out]})

    return pixels.mapInPandas(work, "file_path string, hash bigint, failure_code string")


def mean_color_vector(pixels: np.ndarray, dim: int) -> np.ndarray:
    """The dummy embedding: channel means of the 32 x 32 bilinear image, repeated to ``dim``, unit length (zero stays)."""
    means = np.clip(np.round(resize(pixels, 32, 32, cubic=False)), 0, 255).reshape(-1, 3).mean(0) / 255.0
    v = np.tile(means, -(-dim // 3))[:dim]
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32)


def center_crop_tensor(pixels: np.ndarray, short: int = SHORT, crop: int = CROP) -> np.ndarray:
    """Shortest side to ``short`` (bicubic), centre crop, scaled and normalised, channels first."""
    h, w = pixels.shape[:2]
    nh, nw = (short, int(w * short / h)) if h <= w else (int(h * short / w), short)
    big = np.clip(np.round(resize(pixels, nh, nw)), 0, 255)
    top, left = round((nh - crop) / 2), round((nw - crop) / 2)
    part = big[top : top + crop, left : left + crop] / 255.0
    return ((part - np.array(MEAN)) / np.array(DEVIATION)).transpose(2, 0, 1).astype(np.float32)
