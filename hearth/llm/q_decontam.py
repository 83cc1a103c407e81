"""Query of the decontamination, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.decontam import scan
from hearth.session import table


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
HITS_SQL = rf"""
items AS (SELECT item_id, {_WORDS} AS iw FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(iw), 10) AS n, array_to_string(iw[i : i + least(len(iw), 10) - 1], ' ') AS w
  FROM (SELECT item_id, iw, unnest(range(1, greatest(len(iw) - 10, 0) + 2)) AS i FROM items WHERE len(iw) > 0)),
toks AS (SELECT doc_id, {_WORDS} AS dw FROM {{docs}}),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT doc_id, n, i, array_to_string(dw[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, dw, n, unnest(range(1, len(dw) - n + 2)) AS i FROM toks, lens WHERE len(dw) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, i, a.n FROM spots a JOIN wins USING (n, w))"""
OP5_SQL = f"""WITH {HITS_SQL.format(docs="documents")},
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(dw) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM toks LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""
