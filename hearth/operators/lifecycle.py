"""What happens to stored rows: removal and return, rechecks, verdicts, contacts, states, sources, cursors and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.config import ACTIVE_STATUSES
from hearth.session import settle

GONE_STATUS = (404, 410)
GALLERY = 8


def mark_gone(rows: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """gone (id, reason): off the market; the last sighting stays, flags go."""
    out = rows.join(gone.select("id", F.col("reason").alias("__reason")).dropDuplicates(["id"]), "id", "left")
    hit = F.col("__reason").isNotNull()
    values = {"availability": F.lit("gone"), "removed_at": F.lit(now).cast("timestamp_ntz"), "removed_reason": F.col("__reason"), "flagged": F.lit(0)}
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).drop("__reason")


def person_removal(rows: DataFrame, now: str) -> DataFrame:
    """rows with status and next_status: a tap on gone stamps the row, unless the source did; a tap back clears a person's stamp."""
    tap = (F.col("next_status") == "gone") & F.col("removed_at").isNull()
    back = (F.col("next_status") != "gone") & (F.col("status") == "gone") & (F.col("removed_reason") == "taken")
    at = F.when(tap, F.lit(now).cast("timestamp_ntz")).when(back, F.lit(None)).otherwise(F.col("removed_at"))
    reason = F.when(tap, "taken").when(back, F.lit(None)).otherwise(F.col("removed_reason"))
    return rows.withColumns({"removed_at": at, "removed_reason": reason, "status": F.coalesce("next_status", "status")}).drop("next_status")


def recheck_due() -> Column:
    """Rows that people work on or that are flagged, unless they are gone."""
    return (F.col("status").isin(*ACTIVE_STATUSES) | (F.col("flagged") == 1)) & F.coalesce(F.col("availability") != "gone", F.lit(True))


def recheck(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """id, outcome, price: pages (id, http, parsed, gone, price). Gone by the page's word or by 404 and 410; a page that came
    but wasn't understood is an error and changes nothing; rows whose page wasn't read aren't checked."""
    both = rows.select("id", F.col("price_month_idr").alias("stored")).join(pages, "id")
    parsed, said = F.coalesce("parsed", F.lit(False)), F.coalesce("gone", F.lit(False))
    outcome = (
        F.when(parsed & said, "archived")
        .when(~parsed & F.coalesce(F.col("http").isin(*GONE_STATUS), F.lit(False)), "delisted")
        .when(~parsed, "error")
        .when(F.col("price").isNotNull() & ~F.col("price").eqNullSafe(F.col("stored")), "price")
        .otherwise("same")
    )
    return both.select("id", outcome.alias("outcome"), F.when(outcome == "price", F.col("price")).otherwise(F.col("stored")).alias("price"))


def latest_of(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row for each key: the last by order. For configuration, team states and verdicts."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def shortlisted(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """votes (item, voter, verdict, at, seq): the first yes of the team moves a new row to the shortlist; when the last
    yes is taken back, it is new again. Other states stay."""
    ever = votes.groupBy("item").agg(F.bool_or(F.coalesce(F.col("verdict") == "yes", F.lit(False))).alias("ever"))
    now = latest_of(votes, ["item", "voter"], "at", "seq").groupBy("item").agg(F.count_if(F.col("verdict") == "yes").alias("yes"))
    state = ever.join(now, "item").withColumnRenamed("item", "id")
    status = F.when((F.col("status") == "new") & (F.col("yes") > 0), "shortlist").when((F.col("status") == "shortlist") & F.col("ever") & (F.col("yes") == 0), "new").otherwise(F.col("status"))
    return rows.join(state, "id", "left").withColumn("status", status).drop("ever", "yes")


def new_contacts(known: DataFrame, found: DataFrame) -> DataFrame:
    """whatsapp, name: numbers that no contact has yet, each once (the first name in order)."""
    once = found.filter("whatsapp is not null").groupBy("whatsapp").agg(F.min("name").alias("name"))
    return once.join(known, "whatsapp", "left_anti")


def contact_links(known: DataFrame, found: DataFrame) -> DataFrame:
    """id, whatsapp of found rows that aren't linked yet, each once. known (id, whatsapp)."""
    return found.filter("whatsapp is not null").select("id", "whatsapp").distinct().join(known, ["id", "whatsapp"], "left_anti")


def add_flags(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """flags (id, flag): joined to the rows' red flags, kept ones first."""
    more = flags.groupBy("id").agg(F.array_sort(F.collect_set("flag")).alias("__flags"))
    none = F.array().cast("array<string>")
    return rows.join(more, "id", "left").withColumn("red_flags", F.array_union(F.coalesce("red_flags", none), F.coalesce("__flags", none))).drop("__flags")


def merge_marker(new: Column, old: Column) -> Column:
    """A row that was merged away stays so, whatever its source says later."""
    return F.coalesce(new, old)


def repriced(points: DataFrame, keep: Column) -> DataFrame:
    """id, pos, price: a history read anew, without implausible points and without repeats of the price before."""
    before = F.lag("price").over(Window.partitionBy("id").orderBy("pos"))
    return points.filter(keep).withColumn("before", before).filter("before is null or before <> price").drop("before")


def after_cursor(rows: DataFrame, column: str, cursor) -> tuple[DataFrame, Column]:
    """Rows beyond a stored cursor (null: all), and the aggregate that the cursor becomes when they are done."""
    return (rows if cursor is None else rows.filter(F.col(column) > F.lit(cursor))), F.coalesce(F.max(column), F.lit(cursor))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the processed ones."""
    return rows.join(done.select(key), key, "left_anti")


def enabled_sources(wanted: DataFrame, disabled: DataFrame, named: list[str]) -> DataFrame:
    """Sources of a run: disabled ones only if they are named."""
    return wanted.join(disabled.filter(~F.col("source").isin(*named)) if named else disabled, "source", "left_anti")


def source_registry(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """id, label, place: the stored list in its order, then the registry's missing ones in theirs."""
    missing = registry.join(stored, "id", "left_anti")
    return stored.withColumn("part", F.lit(0)).unionByName(missing.withColumn("part", F.lit(1))).withColumn("place", F.struct("part", "place"))


def source_of_group(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """group, source: the source whose address ends with the group's id, else fb-<id>. sources: a short list."""
    tail = F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1)
    known = sources.select(tail.alias("group"), F.col("id").alias("source")).groupBy("group").agg(F.min("source").alias("source"))
    return groups.join(known, "group", "left").withColumn("source", F.coalesce("source", F.concat(F.lit("fb-"), "group")))


def first_rows(raw: DataFrame, key: str, place: str, dirty: Column) -> DataFrame:
    """A sweep's rows: dirty ones skipped, the first of each key kept."""
    rest = [c for c in raw.columns if c != key]
    return raw.filter(~F.coalesce(dirty, F.lit(False)) & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("r")).select(key, "r.*")


def numbered_lines(lines: DataFrame, column: str = "place") -> DataFrame:
    """Adds a number from 1 to rows in the order in which they are read.

    Partitions are counted, and their counts added up, so each row knows how many come before its partition: only a row
    for each partition comes together. lines has to be a plain reading, whose rows and partitions stay the same.
    """
    at = F.monotonically_increasing_id()
    read = lines.withColumn("__at", at).withColumn("__part", F.shiftright("__at", 33))
    sizes = read.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = sizes.select("__part", before.alias("__before"))
    return read.join(starts, "__part").withColumn(column, F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1).drop("__at", "__part", "__before")


def read_batch(spark, path: str, schema: str, most: int):
    """A batch of JSON records, one a line, and the reason for each one that is refused: no JSON, over the batch's size, no key."""
    rows = numbered_lines(spark.read.text(path)).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "place")
    return rows.select("r.*", "place", F.when(F.col("r._bad").isNotNull(), "not json").when(F.col("place") > most, "over the limit").when(F.col("r.key").isNull(), "no key").alias("refused"))


def read_document(spark, path: str, record: str, field: str = "raw"):
    """Records of files that are one JSON document each, with an array of records in `field`: file, place, the record's columns.

    A file that isn't JSON gives one row with its text in `broken` and no record.
    """
    schema = f"{field} array<struct<{record}>>, broken string"
    files = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(path).select(F.col("_metadata.file_path").alias("file"), field, "broken")
    rows = files.select("file", "broken", F.posexplode_outer(field).alias("place", "r"))
    return rows.select("file", (F.col("place") + 1).alias("place"), "broken", "r.*").filter("broken is not null or place is not null")


def listing_rows(batch: DataFrame, areas: list[str], rent: Column) -> DataFrame:
    """Structured records: a stated price wins, else the text's rent; unknown areas become "other"; what is out of the band is skipped."""
    month = F.coalesce("price_month_idr", F.when(F.col("price_year_idr").isNull(), rent["price_month_idr"]))
    year = F.coalesce("price_year_idr", F.when(F.col("price_month_idr").isNull(), rent["price_year_idr"]))
    rows = batch.withColumns({"price_month_idr": month, "price_year_idr": year, "area": F.when(F.col("area").isin(*areas), F.col("area")).otherwise("other")})
    return rows.withColumn("skipped", F.when(F.col("price_month_idr").isNull() & F.col("price_year_idr").isNull(), "no price").when(~F.coalesce(F.col("bedrooms").between(1, 4), F.lit(True)), "bedrooms"))


def harvest_posts(records: DataFrame, said: Column) -> DataFrame:
    """Harvested records as posts: the date as posted, as said, or of the export; eight pictures at most."""
    posted = F.coalesce("posted_at", said, "exported_at")
    return records.withColumns({"posted_at": posted, "images": F.slice("images", 1, GALLERY)})


def batches(rows: DataFrame, group: str, order: str, size: str, most_bytes: int, most_rows: int) -> DataFrame:
    """Adds batch, from 0 in each group: rows fill a batch in order, and the one that would not fit opens the next.

    Where a batch begins depends on where the one before it began, which running sums cannot say; but from each row on it
    is fixed where the next batch begins. So each row's next beginning is found by running sums, and the beginnings are
    those that can be reached from a group's first row: row numbers are hopped over in doubling steps, in as many joins as
    the logarithm of the most batches in a group. A row that is larger than a batch is one alone. Sizes that are null
    count as 0; rows of equal order are taken in the order of their sizes.
    """
    window = Window.partitionBy(group).orderBy(order, size)
    upto = F.sum(F.coalesce(size, F.lit(0))).over(window.rowsBetween(Window.unboundedPreceding, 0))
    numbered = settle(rows.withColumns({"__n": F.row_number().over(window), "__upto": upto}), "numbered")
    # the first row whose running sum passes what this row may hold: one ordered pass over both kinds of marks
    before = F.col("__upto") - F.coalesce(size, F.lit(0))
    mark = lambda at, kind, n: F.struct(at.alias("at"), F.lit(kind).alias("kind"), n.alias("n"))
    marks = numbered.select(group, F.explode(F.array(mark(F.col("__upto"), 1, F.col("__n")), mark(before + most_bytes, 0, F.col("__n")))).alias("m")).select(group, "m.*")
    # behind a limit (kind 0) the next sum that is larger (kind 1) is the first row that doesn't fit
    beyond = F.min(F.when(F.col("kind") == 1, F.col("n"))).over(Window.partitionBy(group).orderBy(F.col("at").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0))
    fits = marks.withColumn("beyond", beyond).filter("kind = 0")
    last = numbered.groupBy(group).agg((F.max("__n") + 1).alias("end"))
    hop = F.greatest(F.col("n") + 1, F.least(F.coalesce("beyond", "end"), F.col("n") + most_rows, F.col("end")))
    # all joins are of rows with rows: well packed files look small enough to be sent to all tasks, through the driver, and aren't
    hops = settle(fits.join(last.hint("merge"), group).select(group, "n", hop.alias("to"), "end"), "hops")
    begins, count = settle(numbered.filter("__n = 1").select(group, F.lit(1).alias("n"), F.lit(0).cast("long").alias("batch")), "begins"), 1
    while True:
        # beginnings of batches 0 to count - 1 are known; a hop over count batches gives those after them
        more = begins.join(hops.hint("merge"), [group, "n"]).filter("to < end").select(group, F.col("to").alias("n"), (F.col("batch") + count).alias("batch"))
        more = settle(more, "begins")
        if more.isEmpty():
            break
        begins = settle(begins.unionByName(more), "begins")
        two = hops.withColumnsRenamed({"n": "from", "to": "n"}).join(hops.select(group, "n", F.col("to").alias("to2")).hint("merge"), [group, "n"], "left")
        hops, count = settle(two.select(group, F.col("from").alias("n"), F.coalesce("to2", "end").alias("to"), "end"), "hops"), 2 * count
    first = begins.withColumnsRenamed({"n": "__n", "batch": "__first"})
    batch = F.last("__first", ignorenulls=True).over(Window.partitionBy(group).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.join(first.hint("merge"), [group, "__n"], "left").withColumn("batch", batch).drop("__n", "__upto", "__first")


def picture_work(rows: DataFrame) -> DataFrame:
    """id, downloads, hashes: pictures without a file that aren't dead, of rows that aren't gone, and files without a hash."""
    gone = F.coalesce(F.col("availability") == "gone", F.lit(False))
    fetch = F.filter("images", lambda i: i["file"].isNull() & ~F.coalesce(i["dead"], F.lit(False)) & ~gone)
    unhashed = F.filter("images", lambda i: i["file"].isNotNull() & i["hash"].isNull())
    return rows.select("id", F.size(fetch).alias("downloads"), F.size(unhashed).alias("hashes")).filter("downloads > 0 or hashes > 0")


def geocode_work(rows: DataFrame) -> DataFrame:
    """Rows with an address whose pin is missing or only their area's."""
    return rows.filter(F.col("address").isNotNull() & (F.col("lat").isNull() | F.coalesce(F.col("pin_source") == "centroid", F.lit(False))))


def geocoded(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found (address, g_lat, g_lng) written back to the rows that need it; distances that a text states stay."""
    due = F.col("address").isNotNull() & F.col("g_lat").isNotNull() & (F.col("lat").isNull() | F.coalesce(F.col("pin_source") == "centroid", F.lit(False)))
    out = rows.join(found, "address", "left")
    clear = due & ~F.coalesce(F.col("beach_source") == "listing_text", F.lit(False))
    values = {"lat": F.when(due, F.col("g_lat")).otherwise(F.col("lat")), "lng": F.when(due, F.col("g_lng")).otherwise(F.col("lng")), "pin_source": F.when(due, "geocode").otherwise(F.col("pin_source")), "beach_km": F.when(clear, F.lit(None)).otherwise(F.col("beach_km"))}
    return out.withColumns(values).drop("g_lat", "g_lng")
