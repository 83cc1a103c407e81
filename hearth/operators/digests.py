"""Digests that have to stay under a size: shortened in stages, each only as far as the one before it wasn't enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A shortening: the payload before it, and the payload after.
Stage = Callable[[Column], Column]


def json_bytes(value: Column) -> Column:
    """Bytes of a value as JSON, nulls written out."""
    return F.octet_length(F.to_json(value, {"ignoreNullFields": "false"}))


def shortened(text: Column, most: int) -> Column:
    """A longer text's first characters and an ellipsis."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def each(lists: list[str], **changes: Callable[[Column], Column]) -> Stage:
    """Changes fields of all rows of the named lists."""

    def rows(payload: Column, name: str) -> Column:
        def one(row: Column) -> Column:
            for field, change in changes.items():
                row = row.withField(field, change(row[field]))
            return row

        return F.transform(payload[name], one)

    def stage(payload: Column) -> Column:
        for name in lists:
            payload = payload.withField(name, rows(payload, name))
        return payload

    return stage


def dropped_last(name: str, least: int, most_bytes: int) -> Stage:
    """Drops last rows of a list, one by one, until the payload is under the size or `least` rows are left.

    A row takes its JSON and a comma, so the sizes after each drop are known without writing the payload again.
    """

    def stage(payload: Column) -> Column:
        rows = payload[name]
        last_first = F.slice(F.reverse(F.transform(rows, lambda r: json_bytes(r) + 1)), 1, F.greatest(F.lit(0), F.size(rows) - least))
        start = F.struct(json_bytes(payload).alias("size"), F.lit(0).alias("n"))
        drops = F.aggregate(last_first, start, lambda s, b: F.when(s["size"] >= most_bytes, F.struct((s["size"] - b).alias("size"), (s["n"] + 1).alias("n"))).otherwise(s))
        return payload.withField(name, F.slice(rows, 1, F.size(rows) - drops["n"]))

    return stage


def within_budget(payloads: DataFrame, column: str, stages: list[Stage], most_bytes: int) -> DataFrame:
    """Payloads (a struct of lists of rows) after as many stages as it takes to be under the size; adds stages and bytes.

    A payload that is still too large after all stages stays as it is then: nothing further is taken from it. Lists must
    not be null. A null payload stays null, with no stages.
    """
    out = payloads.withColumns({"bytes": json_bytes(F.col(column)), "stages": F.lit(0)})
    for number, stage in enumerate(stages, 1):
        over = F.col("bytes") >= most_bytes
        out = out.withColumns({column: F.when(over, stage(F.col(column))).otherwise(F.col(column)), "stages": F.when(over, number).otherwise(F.col("stages"))})
        out = out.withColumn("bytes", F.when(F.col("stages") == number, json_bytes(F.col(column))).otherwise(F.col("bytes")))
    return out


def digest_stages(most_bytes: int, keep: int = 5) -> list[Stage]:
    """Stages of a digest of the lists new, flagged (title, reasons), changes (title), feedback (title, text), viewings (title, notes)."""
    to = lambda n: (lambda text: shortened(text, n))
    listed = each(["new", "flagged"], title=to(60), reasons=lambda r: F.slice(r, 1, 4))
    changes, said, seen = each(["changes"], title=to(40)), each(["feedback"], title=to(40), text=to(200)), each(["viewings"], title=to(40), notes=to(200))
    return [listed, lambda p: seen(said(changes(p))), dropped_last("new", keep, most_bytes), dropped_last("flagged", keep, most_bytes)]
