"""A bitmap of fixed size over the hashes of a column, for tasks to ask whether a hash may be in the column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB where the number of keys isn't known: a fuller map says yes more often, which costs work but never a result.
BITS = 1 << 26
#: 1 MB to 64 MB where it is.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 29
PARTS = 64


def room(keys: int) -> int:
    """Bits of a map that says yes to a foreign key about once in 16 times, as far as MOST_BITS go."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, keys) - 1).bit_length()))


def _parts(bits: int):
    span = bits // PARTS

    def run(batches):
        maps = {}
        for batch in batches:
            slots = batch.column(0).to_numpy()
            for part in np.unique(slots // span).tolist():
                own = maps.setdefault(part, np.zeros(span, bool))
                own[slots[slots // span == part] - part * span] = True
        for part, own in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["part", "bits"])

    return run


def bitmap(hashes: DataFrame, bits: int = BITS) -> Broadcast:
    """hashes: one long column; bits: a power of 2."""
    slots = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(bits)).cast("long").alias("slot"))
    slots = slots.repartition(F.floor(F.col("slot") / (bits // PARTS)))
    whole = bytearray(bits // 8)
    for row in slots.mapInArrow(_parts(bits), "part int, bits binary").collect():  # PARTS rows, bits / 8 bytes
        at = row["part"] * (bits // PARTS // 8)
        part = np.frombuffer(bytes(row["bits"]), np.uint8) | np.frombuffer(whole[at : at + len(row["bits"])], np.uint8)
        whole[at : at + len(row["bits"])] = part.tobytes()
    return hashes.sparkSession.sparkContext.broadcast(bytes(whole))


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """bits: the broadcast bytes as uint8; hashes: int64."""
    slot = hashes % (8 * len(bits))
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
