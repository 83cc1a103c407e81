"""Query of the repeat removal, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.repeats import remove_repeats
from hearth.session import table


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
rep AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w SEMI JOIN rep USING (h)),
runs AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS s FROM hit),
grp AS (SELECT doc_id, i, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS z FROM grp GROUP BY doc_id, g),
cuts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a - 1 AS y FROM span UNION ALL SELECT doc_id, coalesce((SELECT max(z) FROM span s WHERE s.doc_id = d.doc_id), 1), octet_length(b) FROM d),
kept AS (SELECT doc_id, string_agg(CASE WHEN y >= x THEN hex(b[x:y]) ELSE '' END, '' ORDER BY x) AS k FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM span GROUP BY doc_id) USING (doc_id)"""
