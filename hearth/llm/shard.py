"""Sharding by balanced label propagation over links between equal texts.

Documents with the same text are linked. Every document starts on a shard given by its hash. In each round the blocks
of a group (its rows on one shard) move to the shard that holds most of the group and still has room; what may enter a
shard is limited by its quota. A move goes to where the group has as many rows or more, so rounds end by themselves. Then counts are made even: shard sizes in rows differ by at most one, and what is over
a shard's share (documents without links first) goes to shards that lack rows.

Null texts are never linked; very long texts count as one row; equal rows each get a slot of their own; an empty table gives no rows. Ties go to the
smaller shard. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import settle

#: Rows that one window of the ranking holds, about.
RUN_ROWS = 50_000
#: Linked rows that a shard may hold while labels move, in shares of all rows; what is over a share goes on in whole runs.
SLACK = 1.25


def propagate(blocks: DataFrame, shards: int, quota: int) -> DataFrame:
    """blocks: g, home, n (a group's rows on its first shard) -> g, home, n, label."""
    state = settle(blocks.withColumn("label", F.col("home")), "blocks")
    lanes = max(1, min(1024, state.count() // (shards * RUN_ROWS)))
    while True:
        load = state.groupBy("label").agg(F.sum("n").alias("load"))
        held = state.groupBy("g", "label").agg(F.sum("n").alias("m"))
        # loads: a row for each shard at most
        room = F.broadcast(load.select("label", (F.lit(quota) - F.col("load")).alias("room")))
        held = held.join(room, "label")
        best = held.filter("room > 0").groupBy("g").agg(F.max(F.struct("m", (-F.col("label")).alias("minus"), "room")).alias("b"))
        here = held.select("g", "label", "m")
        moves = (
            state.join(here, ["g", "label"])
            .join(best, "g")
            .filter(F.struct("m", (-F.col("label")).alias("minus")) < F.struct(F.col("b.m"), F.col("b.minus")))
            .select("g", "home", "n", (-F.col("b.minus")).alias("to"), F.col("b.room").alias("room"), F.col("b.m").alias("gain"))
        )
        lane = Window.partitionBy("to", F.pmod(F.xxhash64("g"), F.lit(lanes))).orderBy(F.desc("gain"), F.desc("n"), "g", "home").rowsBetween(Window.unboundedPreceding, 0)
        moves = moves.withColumn("entered", F.sum("n").over(lane)).filter(F.col("entered") * lanes <= F.col("room"))
        moves = settle(moves.select("g", "home", "to"), "moves")
        if moves.isEmpty():
            return state
        state = settle(state.join(moves, ["g", "home"], "left").select("g", "home", "n", F.coalesce("to", "label").cast("int").alias("label")), "blocks")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and linked: whether another document has the same text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.xxhash64(F.lit("null"), "doc_id")).otherwise(F.xxhash64("text")).alias("g"),
    ).withColumn("home", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int"))
    base = settle(base, "docs")
    total = base.count()
    blocks = base.groupBy("g", "home").agg(F.count("*").alias("n"))
    linked = blocks.groupBy("g").agg(F.sum("n").alias("all")).filter("all > 1")
    state = propagate(blocks.join(linked.select("g"), "g"), shards, int(SLACK * -(-total // shards)))
    state = state.join(linked, "g").select("g", "home", "label", "all")

    runs = max(1, -(-total // (shards * RUN_ROWS)))
    # A group of many rows is dealt over several runs.
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1), F.ceil(F.coalesce("all", F.lit(1)) / RUN_ROWS)))
    placed = base.join(state, ["g", "home"], "left").select(
        "doc_id", "size", "text_crc32", "g", F.coalesce("label", "home").alias("label"), F.col("all").isNotNull().alias("linked"),
        (F.pmod(F.xxhash64("g", salt), F.lit(runs)) + F.when(F.col("all").isNull(), runs).otherwise(0)).cast("int").alias("run"),
    )
    placed = settle(placed, "placed")
    sizes = placed.groupBy("label", "run").agg(F.count("*").alias("rows"))  # shards x 2 x runs rows
    before = sizes.select("label", "run", (F.sum("rows").over(Window.partitionBy("label").orderBy("run")) - F.col("rows")).alias("before"))
    order = Window.partitionBy("label", "run").orderBy("g", "doc_id", "size", "text_crc32")
    ranked = placed.join(before, ["label", "run"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)

    # One number for each shard: what it has, its share, and where rows over the share go.
    have = {r["label"]: r["rows"] for r in sizes.groupBy("label").agg(F.sum("rows").alias("rows")).collect()}
    have = [have.get(s, 0) for s in range(shards)]
    share = [total // shards + (s < total % shards) for s in range(shards)]
    over, lack = [max(0, h - t) for h, t in zip(have, share)], [max(0, t - h) for h, t in zip(have, share)]
    before_over, up_to = [sum(over[:s]) for s in range(shards)], [sum(lack[: s + 1]) for s in range(shards)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = lambda xs, s: F.element_at(longs(xs), s + 1)
    ranked = ranked.withColumn("share", at(share, F.col("label"))).withColumn("q", at(before_over, F.col("label")) + F.col("rank") - F.col("share"))
    goes = F.size(F.filter(longs(up_to), lambda x: x <= F.col("q")))
    ranked = ranked.withColumn("shard", F.when(F.col("rank") < F.col("share"), F.col("label")).otherwise(goes).cast("int"))
    kept = [min(h, t) for h, t in zip(have, share)]
    start = [up_to[s] - lack[s] - kept[s] for s in range(shards)]
    slot = F.when(F.col("rank") < F.col("share"), F.col("rank")).otherwise(F.col("q") - at(start, F.col("shard")))
    return ranked.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"), "linked")
