"""A collecting run in phases, each measured while it runs: cards by source, band, details, upsert, unlisting, the run's row.

The order of the phases means something: the band is tested on cards, before any detail is joined; a detail's facts win
over its card's; only sources that ran cleanly may lose rows by not listing them. What a phase counts is observed on the
plan that writes its rows (no second pass), and every phase ends in the shared folder, so a lost executor repeats a
phase's tasks and not the run. A source is a job of its own up to the upsert: when it fails, its rows stay as they are and
the run goes on with the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hearth.operators.duplicates import automatic_pairs, merges_of
from hearth.operators.lifecycle import latest_of
from hearth.operators.upsert import FACTS, FILLED, mark_unlisted, upsert
from hearth.session import settle, shared_dir
from hearth.sources.pages import adapter_of

#: A run's row; opened with the sources and closed with the counts, the later row of an id being the one that counts.
RUN = "id string, kind string, sources array<string>, started_at timestamp, finished_at timestamp, seen bigint, new bigint, updated bigint, gone bigint, errors array<string>, notes array<string>"
PER_SOURCE = "source string, seen bigint, new bigint, updated bigint, unchanged bigint, skipped bigint, error string"
COUNTS = ("seen", "new", "updated", "unchanged", "skipped")


class RunLog:
    """Run rows in a folder, appended when a run opens and when it closes."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/hearth-runs"

    def _append(self, **values) -> None:
        row = [tuple(values.get(f.name) for f in self.spark.createDataFrame([], RUN).schema)]
        self.spark.createDataFrame(row, RUN).coalesce(1).write.mode("append").parquet(self.path)

    def open(self, run: str, kind: str, sources: list[str], now: datetime) -> None:
        self._append(id=run, kind=kind, sources=sources, started_at=now)

    def close(self, run: str, kind: str, sources: list[str], started: datetime, **counts) -> None:
        self._append(id=run, kind=kind, sources=sources, started_at=started, finished_at=datetime.now(timezone.utc), **counts)

    def rows(self) -> DataFrame:
        """One row for each run; a run that never closed has no finish."""
        return latest_of(self.spark.read.schema(RUN).parquet(self.path).withColumn("closed", F.col("finished_at").isNotNull()), ["id"], "closed", "finished_at").drop("closed")


def counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, and what is counted when they are written; sums over no rows are 0."""
    seen = Observation(label)
    return df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()]), seen


def observed(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The settled rows and what was counted while they were written."""
    told, seen = counted(df, label, **counts)
    done = settle(told, label)
    return done, {n: int(v) for n, v in seen.get.items()}


@dataclass
class Outcome:
    rows: DataFrame
    per_source: dict[str, dict] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def table(self) -> DataFrame:
        """A row for each source of the run."""
        spark = self.rows.sparkSession
        return spark.createDataFrame([(s, *(c[n] for n in COUNTS), c["error"]) for s, c in self.per_source.items()], PER_SOURCE)


def overlaid(cards: DataFrame, details: DataFrame, columns: list[str]) -> DataFrame:
    """Cards with their details' facts, where these say something; cards without a detail stand as they are. One detail by id."""
    once = details.groupBy("id").agg(*[F.min(F.struct(F.col(c).isNull(), c))[c].alias(f"d_{c}") for c in columns])
    return cards.join(once, "id", "left").withColumns({c: F.coalesce(f"d_{c}", c) for c in columns}).drop(*[f"d_{c}" for c in columns])


def once(cards: DataFrame) -> DataFrame:
    """Each source's cards by id, the last in order. They are dealt by id alone, so that a join by id needn't deal them again."""
    rest = [c for c in cards.columns if c not in ("id", "source")]
    return cards.repartition("id").groupBy("id", "source").agg(F.max(F.struct(*rest)).alias("r")).select("id", "source", "r.*")


def tally(name: str, sources: list[str], which: Column) -> dict[str, Column]:
    """A count for each source, named name|source."""
    return {f"{name}|{s}": F.count_if(which & (F.col("source") == s)) for s in sources}


def run_sources(
    stored: DataFrame, readers: dict[str, Callable[[], DataFrame]], now: str, in_band: Column, details: DataFrame | None = None, detail_columns: tuple[str, ...] = (), stale_days: int = 3
) -> Outcome:
    """Upserts what each source's reader gives into the stored rows.

    stored: id, source, availability and the columns of an upsert. A reader's rows: the same without history. Rows of
    another source than the reader's, without an id, or repeated by id (the last in order counts) don't come through.
    A source that had live rows and lists none has failed. Rows of sources that ran cleanly, unseen for stale_days, become
    unlisted.
    """
    outcome, batches = Outcome(stored), []
    live = {r["source"]: r["n"] for r in stored.filter(~F.coalesce(F.col("availability").isin("gone", "unlisted"), F.lit(False))).groupBy("source").agg(F.count("*").alias("n")).filter(F.col("source").isin(*readers)).collect()}
    for source, read in readers.items():
        counts = outcome.per_source[source] = {**dict.fromkeys(COUNTS, 0), "error": None}
        try:
            cards = read()
            cards = cards.filter((F.col("source") == source) & F.col("id").isNotNull()).withColumn("__in", F.coalesce(in_band, F.lit(False)))
            once(cards)  # rows that have no order are their source's error, too
            cards, found = observed(cards, f"cards-{source}", n=F.count("*"))
        except PySparkException as failure:  # this source's alone
            counts["error"] = type(failure).__name__
            outcome.errors.append(f"{source}: {type(failure).__name__}")
            continue
        if not found["n"] and live.get(source):
            counts["error"] = "silent"
            outcome.errors.append(f"{source}: no rows, {live[source]} live ones before")
            continue
        batches.append(cards)
    clean = [s for s, c in outcome.per_source.items() if c["error"] is None]
    if batches:
        batch, told = counted(once(reduce(DataFrame.unionByName, batches)), "cards", **tally("seen", clean, F.lit(True)), **tally("skipped", clean, ~F.col("__in")))
        batch = batch.filter("__in").drop("__in")
        if details is not None:
            batch = overlaid(batch, details, list(detail_columns))
        merged = upsert(stored, batch, now, (*FACTS, "source"), FILLED)
        done = lambda name, action: tally(name, clean, F.col("action") == action)
        merged, acted = observed(merged, "upsert", **done("new", "inserted"), **done("updated", "updated"), **done("unchanged", "unchanged"))
        for key, n in (told.get | acted).items():
            name, source = key.split("|", 1)
            outcome.per_source[source][name] = int(n)
        outcome.rows = merged.drop("action")
    if clean:
        outcome.rows = mark_unlisted(outcome.rows, clean, now, stale_days)
    return outcome


def run(log: RunLog, run_id: str, stored: DataFrame, readers: dict[str, Callable[[], DataFrame]], now: str, in_band: Column, disabled: tuple[str, ...] = (), named: tuple[str, ...] = (), **more) -> Outcome:
    """A logged run: disabled sources are left out unless they are named; the row is open until all phases are through."""
    wanted = {s: r for s, r in readers.items() if s in named or (not named and s not in disabled)}
    started = datetime.now(timezone.utc)
    log.open(run_id, "collect", list(wanted), started)
    outcome = run_sources(stored, wanted, now, in_band, **more)
    total = {n: sum(c[n] for c in outcome.per_source.values()) for n in COUNTS}
    notes = [f"{s}: " + ", ".join(f"{n} {c[n]}" for n in COUNTS) for s, c in outcome.per_source.items()]
    log.close(run_id, "collect", list(wanted), started, seen=total["seen"], new=total["new"], updated=total["updated"], gone=0, errors=outcome.errors, notes=notes)
    return outcome


def inbox(pending: DataFrame, pages: DataFrame, adapters: dict[str, str], detail: Callable[[Column], Column]) -> DataFrame:
    """Addresses that people left, with what their page says: id, url, adapter, status, note, d (the detail).

    pending: id, url, note, status. The page of an address is looked up (the last in order, if there are several), read by
    `detail` (null: nothing was found), and goes on without the band's test: a person asked for it. Rows that aren't
    pending are left out.
    """
    once = pages.groupBy("url").agg(F.max("html").alias("html"))
    rows = pending.filter("status = 'pending'").join(once, "url", "left").withColumn("d", detail(F.col("html")))
    found = F.col("d").isNotNull()
    note = F.concat_ws(" | ", F.nullif("note", F.lit("")), F.when(found, F.concat(F.lit("read by "), adapter_of(F.col("url"), adapters))).otherwise("no listing data"))
    return rows.select("id", "url", adapter_of(F.col("url"), adapters).alias("adapter"), F.when(found, "done").otherwise("failed").alias("status"), note.alias("note"), "d")


def without_merged(dismissed: DataFrame, merges: DataFrame) -> DataFrame:
    """Dismissed pairs (a, b) without those that were merged, in whichever order."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).alias("pair")
    return dismissed.withColumn("pair", pair("a", "b")).join(merges.select(pair("keep", "gone")), "pair", "left_anti").drop("pair")


def duplicate_pass(log: RunLog, run_id: str, rows: DataFrame, dismissed: DataFrame, posts: list[str], by: str, promo: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(keep, gone) of one pass that a person asked for, and the dismissals (a, b) that are left: a merged pair is settled,
    in whichever order it was dismissed. The run's row is closed with the error if the pass fails."""
    started = datetime.now(timezone.utc)
    log.open(run_id, "duplicates", [], started)
    try:
        merges, counts = observed(merges_of(automatic_pairs(rows, promo), posts), "merges", n=F.count("*"))
    except PySparkException as failure:
        log.close(run_id, "duplicates", [], started, errors=[f"duplicates: {type(failure).__name__}"], notes=[f"run by {by}"])
        raise
    left = without_merged(dismissed, merges)
    log.close(run_id, "duplicates", [], started, gone=counts["n"], errors=[], notes=[f"run by {by}", f"{counts['n']} merged"])
    return merges, left
