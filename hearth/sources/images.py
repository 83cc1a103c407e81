"""Photos: difference hashes of decoded pictures, and photos that two listings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 9, 8
SAME_BITS = 6


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded by the JVM; what can't be decoded is dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def shrink(pixels: np.ndarray, height: int = HEIGHT, width: int = WIDTH) -> np.ndarray:
    """Means of the areas that the target's cells cover."""
    for axis, size in ((0, height), (1, width)):
        edges = np.linspace(0, pixels.shape[axis], size + 1)
        total = np.concatenate((np.zeros_like(np.take(pixels, [0], axis)), np.cumsum(pixels, axis)), axis)
        low = np.minimum(edges.astype(int), pixels.shape[axis] - 1)
        shape = (-1, 1) if axis == 0 else (1, -1)
        at = np.take(total, low, axis) + (edges - low).reshape(shape) * np.take(pixels, low, axis)
        pixels = np.diff(at, axis=axis) / np.diff(edges).reshape(shape)
    return pixels


def difference_hash(height: int, width: int, channels: int, data: bytes) -> int:
    """64 bits, row by row: set where a cell is brighter than the one to its right."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    grey = raw[:, :, 0] if channels < 3 else raw[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # blue, green, red
    small = shrink(grey)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int(np.packbits(bits).view(">u8")[0])


def photo_hashes(images: DataFrame) -> DataFrame:
    """origin, hash (16 hex digits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [f"{difference_hash(h, w, c, d):016x}" for h, w, c, d in zip(rows["height"], rows["width"], rows["nChannels"], rows["data"])]
            yield pd.DataFrame({"origin": rows["origin"], "hash": found})

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, hash string")


def _bits(hash: Column) -> Column:
    """A hash of hex digits as a number; null if it is malformed."""
    return F.when(hash.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(hash, 16, -10).cast("long"))


def same_photo(a: Column, b: Column) -> Column:
    """Equal addresses, or hashes within SAME_BITS; what is malformed is never the same."""
    close = F.bit_count(_bits(a["hash"]).bitwiseXOR(_bits(b["hash"]))) <= SAME_BITS
    return F.coalesce((a["url"] == b["url"]) & (a["url"] != ""), F.lit(False)) | F.coalesce(close, F.lit(False))


def shared_photos(left: Column, right: Column) -> Column:
    """Photos (arrays of struct<url, hash>) of two listings that are the same, each used once, in their order."""
    kind = "array<struct<url:string,hash:string>>"
    pack = lambda rest, n: F.struct(rest.cast(kind).alias("rest"), n.cast("int").alias("n"))

    def take(s: Column, photo: Column) -> Column:
        at = F.array_position(F.transform(s["rest"], lambda other: same_photo(photo, other)), True).cast("int")
        rest = F.concat(F.slice(s["rest"], F.lit(1), at - 1), F.slice(s["rest"], at + 1, F.size(s["rest"])))
        return F.when(at > 0, pack(rest, s["n"] + 1)).otherwise(s)

    none = F.array().cast(kind)
    return F.aggregate(F.coalesce(left, none), pack(F.coalesce(right, none), F.lit(0)), take, lambda s: s["n"])
