"""Incremental forms over a stream of events: windows with late data, de-duplication and bursts with timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearth.session import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream; ts becomes an instant, as watermarks need."""
    schema = spark.read.parquet(path).schema
    any_kind = f"{path[:-1]}[{path[-1]}]"  # a plain path has to be a folder, a pattern may match a file
    return spark.readStream.schema(schema).parquet(any_kind).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs over all there is and returns the result: of the last batch for complete output, of all of them for append."""
    spark, out = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/hearth-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again overwrites itself
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def run_in_slices(rows: DataFrame, slices: list, make, mode: str = "append") -> DataFrame:
    """The rows arrive slice by slice (conditions, in order), each followed by a run over what is new; make: from the
    stream of rows to the result. State, watermark and output go on from run to run."""
    spark, out = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/hearth-slices-{uuid.uuid4().hex}"
    schema = None
    for condition in slices:
        rows.filter(condition).write.mode("append").parquet(f"{out}/in")
        stream = make(spark.readStream.schema(rows.schema).parquet(f"{out}/in"))
        schema = stream.schema

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows").select(*schema.names)


def windowed_counts(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def first_of_each(stream: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Each key once, if repetitions come within the allowed time."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def smallest_of_each(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the smallest `order` of each key, whenever it arrives; for the mode update: each run tells the keys that
    it saw, and the smallest that was told of a key is the result."""
    rest = [c for c in stream.columns if c not in (key, order)]
    least = F.min(F.struct(order, *rest)).alias("r")
    return stream.groupBy(key).agg(least).select(key, "r.*")


BURST = "chat long, sender string, n long, first_ts timestamp, last_ts timestamp"


def stream_bursts(stream: DataFrame, gap_minutes: float) -> DataFrame:
    """Bursts of one sender in a chat; a burst closes at another sender, a long gap, or when the watermark passes it."""
    gap = gap_minutes * 60

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = [], state.getOption
        if state.hasTimedOut:
            done.append((key[0], *held))
            state.remove()
        else:
            rows = pd.concat(batches).sort_values("ordinal")
            for sender, ts in zip(rows["sender"], rows["ts"]):
                if held and held[0] == sender and (ts - held[3]).total_seconds() <= gap:
                    held = (sender, held[1] + 1, held[2], max(held[3], ts))
                else:
                    if held:
                        done.append((key[0], *held))
                    held = (sender, 1, ts, ts)
            state.update(held)
            state.setTimeoutTimestamp(int(held[3].timestamp() * 1000 + gap * 1000 + 1))
        yield pd.DataFrame(done, columns=["chat", "sender", "n", "first_ts", "last_ts"])

    rows = stream.withWatermark("ts", f"{max(1, int(gap))} seconds").groupBy("chat")
    return rows.applyInPandasWithState(step, BURST, "sender string, n long, first_ts timestamp, last_ts timestamp", "append", GroupStateTimeout.EventTimeTimeout)
