"""Query of the license scan."""

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.licence import scan
from hearth.session import table


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
