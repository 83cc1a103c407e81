"""Results and the cursor they go up to, committed together: a run that is broken off and repeated loses and repeats nothing.

A batch's rows are written into a folder of its own. What makes them count is a commit: a one-row table named by the
batch's number, with the folder, the cursor before and the cursor after. A folder without a commit isn't there for
readers, and the run that comes next writes its rows anew. The commit of a number is written once; a run that finds it
there has been overtaken (or repeats a batch that was committed) and leaves it as it is. All reading and writing is
Spark's, so the folder may be in any store; one writer at a time is what streaming's own checkpoints ask for, too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "batch bigint, folder string, cursor_before string, cursor_after string, rows bigint, kind string"


@dataclass(frozen=True)
class Commit:
    """The last one: the batch's number and the cursor it went up to; -1 and null before the first."""

    batch: int
    cursor: str | None


class CursorSink:
    """Rows by batch under `path`, each with the cursor it goes up to."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self, path: str) -> bool:
        store = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return store.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(store)

    def commits(self) -> DataFrame:
        """All commits; a commit's folder counts only with Spark's mark of a finished write."""
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")

    def last(self) -> Commit:
        row = self.commits().agg(F.max_by(F.struct("batch", "cursor_after"), "batch").alias("c")).first()["c"]
        return Commit(-1, None) if row is None else Commit(row["batch"], row["cursor_after"])

    def rows(self, upto: int | None = None) -> DataFrame:
        """All committed rows, with their batch; upto: as of a batch."""
        done = self.commits() if upto is None else self.commits().filter(F.col("batch") <= upto)
        folders = [r["folder"] for r in done.select("folder").collect()]  # a row for each batch
        read = self.spark.read.schema(self.schema)
        empty = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))
        if not folders:
            return empty
        files = read.parquet(*folders).withColumn("folder", F.regexp_extract("_metadata.file_path", r"/rows/([^/]+)/", 1))
        return files.join(done.select("batch", F.regexp_extract("folder", r"/rows/([^/]+)$", 1).alias("folder")), "folder").drop("folder")

    def commit(self, batch: int, rows: DataFrame, cursor: str | None, before_commit: Callable[[], None] | None = None, kind: str = "run") -> bool:
        """Write the rows of a batch and its cursor; False if the batch had been committed. before_commit: for tests."""
        target = f"{self.path}/commits/batch={batch:012d}"
        if self._exists(f"{target}/_SUCCESS"):
            return False
        folder = f"{self.path}/rows/{batch:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        if before_commit:
            before_commit()
        count = self.spark.read.schema(self.schema).parquet(folder).count()
        row = [(batch, folder, self.last().cursor, cursor, count, kind)]
        self.spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("overwrite").parquet(target)
        return True


def advance(sink: CursorSink, source: DataFrame, column: str, work: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> Commit:
    """One run: the rows of the source beyond the stored cursor go through work into the sink, and the cursor to the
    largest value among them. Without new rows nothing is committed. column: numbers or instants, not null where they count."""
    last = sink.last()
    kind = source.schema[column].dataType.simpleString()
    fresh = source.filter(F.col(column).isNotNull())
    if last.cursor is not None:
        fresh = fresh.filter(F.col(column) > F.lit(last.cursor).cast(kind))
    upto = fresh.agg(F.max(column).cast("string")).first()[0]
    if upto is None:
        return last
    # rows that arrive while this runs are beyond the cursor, and the next run's
    sink.commit(last.batch + 1, work(fresh.filter(F.col(column) <= F.lit(upto).cast(kind))), upto, before_commit)
    return sink.last()


def stream_into(sink: CursorSink, stream: DataFrame, column: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda rows: rows, fail_at: int | None = None):
    """The stream's micro-batches as batches of the sink, by their numbers: a batch that streaming tries again finds its
    commit and does nothing, or, if it was broken off before that, writes its rows anew. fail_at: for tests."""

    def write(batch: DataFrame, number: int) -> None:
        def stop() -> None:
            if number == fail_at:
                raise RuntimeError(f"stopped between the rows and the commit of batch {number}")

        batch.persist()
        try:
            upto = batch.agg(F.max(column).cast("string")).first()[0]
            sink.commit(number, work(batch), upto if upto is not None else sink.last().cursor, stop, "stream")
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
