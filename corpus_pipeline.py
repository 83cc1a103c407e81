"""From raw documents to token digests: five stages, each written as Parquet and read again.

All stages take documents with any further columns (names that operators use inside may occur), null or repeated
doc_ids, null, empty and very long texts, and empty tables; each stage's docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.bpe import encode
from hearth.llm.decontam import decontaminate
from hearth.llm.pii import pseudonymise
from hearth.llm.q_pii import secret_of
from hearth.llm.quality import keep_good
from hearth.llm.simhash import deduplicate
from hearth.session import settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts get the score of an empty document and stay or go by it. Equal rows have equal scores and stay
    or go together; a score at the threshold stays. All columns are kept; an empty table gives none.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id, null after all others.

    Null and empty texts are near each other. Of equal rows one stays. Long texts are compared by whole sets of
    shingles. All columns are kept; an empty table gives none.
    """
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows go.

    Null and empty texts have no windows and stay; equal rows stay or go together; long texts are read whole. All
    columns are kept; an empty table, or an empty benchmark, takes nothing away.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, addresses and dates become pseudonyms; n_chars, where there is one, follows the text.

    Every row stays. Null texts stay null, empty ones empty; equal values get equal pseudonyms in all documents. The key
    is the setting spark.hearth.pii.key, or else a secret of this run alone.
    """
    out = pseudonymise(docs, secret_of(spark), "__hearth_pii").drop("__hearth_pii")
    return out.select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(n) if n == "n_chars" else n for n in out.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each document.

    Null texts are encoded as empty ones (no tokens); equal texts have equal digests; long texts are encoded whole.
    """
    return encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]
#: The classifier is trained, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
