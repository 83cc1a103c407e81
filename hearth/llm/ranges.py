"""Ranges of a total order, for scans that need rows in order but not in one task.

A scan over ranges is told the first key of each. What a range needs of its neighbours (the row after its last, or the
phrases that its first key begins with) is known by these keys alone, and is sent along as copies: no task waits for
another, and no range depends on how Spark partitions rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranges for each shuffle partition: ranges are dealt by hash, and several in each partition even out.
EACH = 8


def _every(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % step, batch.num_rows, step), pa.int64()))
            seen += batch.num_rows

    return run


def firsts(keys: DataFrame, ranges: int | None = None) -> list[tuple]:
    """First keys of near equal ranges, ascending by all columns; the least key is among them.

    They are keys of the table, about `ranges` of them and at most a partition's one more each, whatever the table's
    size: only these come to the driver. Equal keys are in one range. An empty table gives none.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, -(-keys.count() // (ranges or EACH * parts)))
    ordered = keys.repartitionByRange(parts, *keys.columns).sortWithinPartitions(*keys.columns)
    found = [tuple(row) for row in ordered.mapInArrow(_every(step), keys.schema).collect()]
    return [key for i, key in enumerate(found) if not i or key != found[i - 1]]
