"""Ids that an archive holds already, by group: Bloom filters that are kept and merged, and an exact answer behind them.

A group's filter is a number of blocks of 32,768 bits, a row each; all bits of an id lie in one block, so that asking is
one join on (group, block). Blocks are Spark's own bitmaps: they are built with a partial aggregate before the shuffle, and
the filters of two runs are merged by an aggregate over their rows, without reading the archive again. A filter never
overlooks an id; about one foreign id in 400 looks known, and that is settled by an exact anti-join with the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.session import settle

BLOCK = 32_768
#: Bits for each id, and how many of them an id sets.
ROOM, SET = 16, 4
#: Blocks of a filter that is sent to all tasks, at most (64 MB): beyond it the archive is shuffled as it is.
SENT = 16_384
#: Blocks whose ids one task gathers, and groups whose rooms are sent to all tasks, at most.
DEALT, FEW = 512, 100_000


def archive_group(file: Column, inside: Column) -> Column:
    """The group of an archive file: the tag in its name, or, where it was saved under the tag "final", the group inside it."""
    tag = F.regexp_extract(file, r"posts-([^-/]+)-[^/]*$", 1)
    return F.when(tag == "final", inside).otherwise(F.nullif(tag, F.lit("")))


def archived_ids(posts: DataFrame) -> DataFrame:
    """file, group_id (that inside the file), post_id -> group, id, each once; posts without an id or a group aren't known."""
    rows = posts.select(archive_group(F.col("file"), F.col("group_id")).alias("group"), F.col("post_id").cast("string").alias("id"))
    return rows.filter("group is not null and id <> ''").distinct()


def _bits() -> list[Column]:
    """Places in its block of an id: parts of 15 bits of a hash that isn't the block's."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(1), "id"), 15 * i).bitwiseAND(F.lit(BLOCK - 1)).cast("int") for i in range(SET)]


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks)


def sizes(ids: DataFrame) -> DataFrame:
    """group, blocks: room for the ids of each group and as many again, as a power of two."""
    n = F.count("*") * 2 * ROOM / BLOCK
    return ids.groupBy("group").agg(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), n)))).cast("long").alias("blocks"))


def _named(rows: DataFrame, room: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Adds blocks and block. few: a join by group alone would put a group's rows into one task, so the rooms of few groups are sent."""
    return rows.join(F.broadcast(room) if few else room, "group", how).withColumn("block", _block(F.col("blocks")))


def bloom(ids: DataFrame, room: DataFrame | None = None) -> DataFrame:
    """group, blocks, block, bits: the filter of (group, id). room: group, blocks of a filter that this one is to be merged with.

    The ids of DEALT blocks, some 1,000 each at most, are a task's share: bitmaps are aggregated by sorting, which would
    take as much memory as there is for whatever a task holds.
    """
    room = settle(sizes(ids) if room is None else room, "rooms")
    groups, blocks = room.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    rows = _named(ids, room, groups <= FEW).select("group", "blocks", "block", *[bit.alias(f"b{i}") for i, bit in enumerate(_bits())])
    by = ["group", "blocks", "block"]
    each = rows.repartition(max(1, -(-blocks // DEALT)), *by).groupBy(*by).agg(*[F.bitmap_construct_agg(f"b{i}").alias(f"b{i}") for i in range(SET)])
    return each.select(*by, F.explode(F.array(*[f"b{i}" for i in range(SET)])).alias("bits")).groupBy(*by).agg(F.bitmap_or_agg("bits").alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of several with equal room."""
    out = filters[0]
    for more in filters[1:]:
        out = out.unionByName(more)
    return out.groupBy("group", "blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def rooms(filters: DataFrame) -> DataFrame:
    """group, blocks of a stored filter."""
    return filters.select("group", "blocks").distinct()


def _has(bits: Column, place: Column) -> Column:
    byte = F.ascii(F.decode(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return F.call_function("shiftright", byte, place % 8).bitwiseAND(F.lit(1)) == 1


def asked(rows: DataFrame, filters: DataFrame, send: bool = False) -> DataFrame:
    """Adds maybe: whether (group, id) may be in the filter. send: the filter is small enough for all tasks."""
    hint = F.broadcast if send else (lambda df: df)
    room = rooms(filters)
    keyed = _named(rows, room, send or room.count() <= FEW, "left")
    keyed = keyed.join(hint(filters.select("group", "block", "bits")), ["group", "block"], "left")
    found = F.col("bits").isNotNull()
    for place in _bits():
        found = found & _has(F.col("bits"), place)
    return keyed.withColumn("maybe", F.coalesce(found, F.lit(False))).drop("blocks", "block", "bits")


def unknown(batch: DataFrame, archive: DataFrame, filters: DataFrame, sent: int = SENT) -> DataFrame:
    """The rows of the batch whose (group, id) the archive doesn't hold; filters: the archive's.

    Rows that the filter doesn't know are new, and the archive isn't asked. The others' ids make a filter of their own,
    which goes to the archive's scan (where it is small enough), so only archive rows that may be meant are shuffled for
    the exact anti-join. Null groups and ids are never known; repeated rows of the batch stay repeated.
    """
    probed = settle(asked(batch, filters), "asked")
    doubtful = probed.filter("maybe").drop("maybe")
    ids = doubtful.select("group", "id").distinct()
    own = settle(bloom(ids), "doubtful")
    held = archive.select("group", "id")
    if own.count() <= sent:
        held = asked(held, own, send=True).filter("maybe").drop("maybe")
    return probed.filter("not maybe").drop("maybe").unionByName(doubtful.join(held, ["group", "id"], "left_anti"))
