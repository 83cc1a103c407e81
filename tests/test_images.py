"""Difference hashes of small pictures, and photos in common."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from hearth.sources import images


def png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_hashes_of_files(spark, tmp_path):
    base = np.random.default_rng(0).integers(0, 255, (8, 9, 1)).repeat(3, axis=2)
    large = base.repeat(20, axis=0).repeat(20, axis=1)
    for name, pixels in (("a", large), ("b", np.clip(large + 3, 0, 255)), ("c", large[:, ::-1])):
        (tmp_path / f"{name}.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r["origin"].rsplit("/", 1)[1][0]: int(r["hash"], 16) for r in images.photo_hashes(images.read_images(spark, f"file://{tmp_path}")).collect()}
    grey = base[:, :, 0]
    want = sum(int(b) << (63 - i) for i, b in enumerate((grey[:, :-1] > grey[:, 1:]).ravel()))
    assert set(got) == {"a", "b", "c"}
    assert got["a"] == want and (got["a"] ^ got["b"]).bit_count() <= 6 < (got["a"] ^ got["c"]).bit_count()


def test_shrink_keeps_means():
    x = np.random.default_rng(1).random((13, 31))
    assert np.isclose(images.shrink(x).mean(), x.mean())


def test_shared_photos(spark):
    schema = "a array<struct<url: string, hash: string>>, b array<struct<url: string, hash: string>>"
    rows = [
        ([("u", None), ("v", "00ff")], [("u", None), ("w", "00fe")], 2),
        ([("u", None)], [("u", None), ("u", None)], 1),
        ([(None, "zz")], [(None, "zz")], 0),
        (None, [("u", None)], 0),
        ([(None, "00"), (None, "01")], [(None, "03")], 1),
    ]
    frame = spark.createDataFrame([(a, b) for a, b, _ in rows], schema)
    assert [r[0] for r in frame.select(images.shared_photos(F.col("a"), F.col("b"))).collect()] == [n for *_, n in rows]
