"""Query of the near-duplicate search."""

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.simhash import hex_digits, near_duplicates
from hearth.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", hex_digits(out["fp"]).alias("fingerprint"), "component_id")
