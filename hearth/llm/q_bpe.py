"""Query of the BPE encoder."""

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.bpe import encode
from hearth.session import table


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
