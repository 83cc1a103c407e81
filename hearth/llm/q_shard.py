"""Query of the sharder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.shard import shard
from hearth.session import table


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
