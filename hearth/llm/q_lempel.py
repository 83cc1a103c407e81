"""Query of the Lempel-Ziv fingerprints. SQL has no parser into phrases: tests hold it against plain Python."""

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.lempel import successors
from hearth.session import table


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successors(table(spark, sf_dir, "documents"))
