"""Query of the pseudonyms."""

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.pii import pseudonymise
from hearth.session import table

KINDS = ("email", "ip", "date", "ssn", "phone", "card")
#: Only for tests and checks: anybody can invert pseudonyms made with it.
KEY = "public-test-key"
KEY_SETTING = "spark.hearth.pii.key"


def key_of(spark: SparkSession) -> str:
    """The secret in the session's setting; without one the public key, with a warning."""
    own = spark.conf.get(KEY_SETTING, None)
    if not own:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are made with a public key", stacklevel=2)
    return own or KEY


def secret_of(spark: SparkSession) -> str:
    """The secret in the session's setting; without one a secret made for this run alone, with a warning: equal values have
    equal pseudonyms within the run, and nobody can invert them or link them with another run's."""
    own = spark.conf.get(KEY_SETTING, None)
    if not own:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms of this run can't be linked with those of others", stacklevel=2)
    return own or secrets.token_hex(32)


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.size("pii").cast("long").alias("n_values"), *counts, "text")
