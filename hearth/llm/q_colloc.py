"""Query of the collocations, and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.colloc import collocations
from hearth.session import table


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("cut")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS k FROM lists))),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
total AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 100),
cand AS (SELECT * FROM often WHERE len(g) >= 2),
inside AS (
  SELECT DISTINCT lang, g[i : i + k - 1] AS g, f FROM (SELECT lang, g, f, k, unnest(range(1, len(g) - k + 2)) AS i FROM (SELECT lang, g, f, unnest(range(2, len(g))) AS k FROM cand))),
kept AS (SELECT lang, g, c.f AS a FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.f >= 100 * c.f)),
cuts AS (
  SELECT x.lang, x.g, x.a, x.k, l.f AS l, r.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept) x JOIN often l ON l.lang = x.lang AND l.g = x.g[1 : k] JOIN often r ON r.lang = x.lang AND r.g = x.g[k + 1 :] JOIN total t ON t.lang = x.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""
