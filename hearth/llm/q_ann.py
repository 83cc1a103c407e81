"""Query of the nearest neighbours."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.ann import search
from hearth.session import table


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found
