"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with document words.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. A window occurs
only where its rarest word occurs (for exact containment the necessary prefix is one token), so document words are
joined with the rarest words alone; rarity is counted over all documents. Length and position bounds and an exact
comparison of the words follow.

Null and empty texts have no words. Equal texts get equal results. Null item ids count as no item. Empty tables give
no hits. Extra columns are ignored by the search and kept by `decontaminate`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.session import settle

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and words up to which their side of a join is broadcast: about 40 MB.
BROADCAST_ROWS = 200_000
#: Keys of texts with hits (16 bytes each) up to which they are broadcast: about 80 MB.
BROADCAST_KEYS = 1_000_000


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def windows(bench: DataFrame, width: int) -> DataFrame:
    """item_id, wkey, w, n: one row for each different window of an item."""
    items = bench.select("item_id", words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    each = F.when(F.size("iw") <= width, F.array("iw")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("iw") - width + 1)), lambda i: F.slice("iw", i, width)))
    return items.select("item_id", F.explode(each).alias("w")).select("item_id", F.md5(F.array_join("w", " ")).alias("wkey"), "w", F.size("w").alias("n")).distinct()


def small(df: DataFrame, limit: int) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def search(docs: DataFrame, bench: DataFrame, width: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with tkey and n_words; windows (item_id, wkey); hits (tkey, start, n, wkey): where a window occurs."""
    toks = docs.select("*", text_key(F.col("text")).alias("tkey"), words(F.col("text")).alias("words"))
    toks = settle(toks.drop("text").withColumn("n_words", F.size("words").cast("long")), "words")
    wins = settle(windows(bench, width), "windows")
    forms = wins.select("wkey", "w", "n").distinct()

    parts = forms.select("wkey", F.posexplode("w").alias("off", "tok"))
    vocab = small(parts.select("tok").distinct(), broadcast_rows)
    counts = toks.select(F.explode("words").alias("tok")).join(vocab, "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("freq"))
    rare = parts.join(counts, "tok", "left").groupBy("wkey").agg(F.min_by(F.struct("tok", "off"), F.struct(F.coalesce("freq", F.lit(0)), "tok", "off")).alias("r"))
    prefix = settle(forms.join(rare, "wkey").select("wkey", "w", "n", F.col("r.tok").alias("tok"), F.col("r.off").alias("off")), "prefix")

    few = small(prefix, broadcast_rows)
    start = (F.col("p") - F.col("off")).alias("start")
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    same = (F.get("words", F.col("start")) == F.get("w", F.lit(0))) & (F.slice("words", F.greatest(F.lit(1), F.col("start") + 1), F.col("n")) == F.col("w"))
    if few is not prefix:
        at = toks.select("tkey", "n_words", "words", F.posexplode("words").alias("p", "tok"))
        hits = at.join(few, "tok").select("*", start).filter(inside & same)
    else:  # more windows than may be broadcast: only keys and positions are shuffled, words join the candidates
        at = toks.select("tkey", "n_words", F.posexplode("words").alias("p", "tok"))
        near = at.join(prefix, "tok").select("tkey", "wkey", "w", "n", "n_words", start).filter(inside).distinct()
        hits = near.join(toks.select("tkey", "words"), "tkey").filter(same)
    hits = settle(hits.select("tkey", "start", "n", "wkey").distinct(), "hits")
    return toks.drop("words"), wins, hits


def scan(docs: DataFrame, bench: DataFrame, width: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, items."""
    toks, wins, hits = search(docs.select("doc_id", "text"), bench, width, broadcast_rows)
    covered = hits.select("tkey", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct().groupBy("tkey").agg(F.count("*").alias("n_hit"))
    found = hits.select("tkey", "wkey").distinct().join(wins.select("wkey", "item_id"), "wkey").groupBy("tkey").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return toks.join(covered.join(found, "tkey", "left"), "tkey", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = 10, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The documents without any hit, with all their columns."""
    _, _, hits = search(docs.select("text"), bench, width)
    key = "__hearth_tkey"
    keys = hits.select(F.unhex("tkey").alias(key)).distinct()
    return docs.withColumn(key, F.unhex(text_key(F.col("text")))).join(small(keys, broadcast_keys), key, "left_anti").select(*docs.columns)
