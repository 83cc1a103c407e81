"""Query of the quality classifier."""

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.quality import scores
from hearth.session import table


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
