"""Chat exports: lines to messages, in file order, with continuation lines joined to their message."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.functions.facts import _part

#: Marks that phones put around names and attachments.
MARKS = "[‎‏‪-‮⁦-⁩﻿]"
_DATE, _TIME = r"(\d{1,2})[/.](\d{1,2})[/.](\d{2,4})", r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?(?:\s*([AaPp])\.?[Mm]\.?)?"
HEADER = rf"^(?:\[{_DATE},?\s+{_TIME}\]|{_DATE},?\s+{_TIME}\s+[-–])\s+(.*)$"
SCHEMA = "file string, ordinal bigint, ts timestamp_ntz, sender string, text string, attachments array<string>, omitted boolean, edited boolean, deleted boolean, system boolean"


def chat_in(name: str, data: bytes, depth: int = 2) -> str | None:
    """The chat's text in an export: the file itself, or the likeliest text in an archive or in one inside it."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return data.decode("utf-8", "replace") if name.lower().endswith(".txt") else None
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        members = [m for m in archive.infolist() if not m.is_dir() and not m.filename.startswith("__MACOSX")]
        texts = [m for m in members if m.filename.lower().endswith(".txt")]
        if texts:  # a chat's usual names first, then the largest
            best = max(texts, key=lambda m: (re.search(r"(?i)(?:^|/)(?:_chat|whatsapp chat[^/]*)\.txt$", m.filename) is not None, m.file_size))
            return archive.read(best).decode("utf-8", "replace")
        inner = [chat_in(m.filename, archive.read(m), depth - 1) for m in members if depth and m.filename.lower().endswith(".zip")]
        return next((x for x in inner if x is not None), None)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """file, content: one row for each export of a folder or a pattern, archives opened in the tasks; files without a chat are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"file": rows["path"], "content": [chat_in(p, bytes(c)) for p, c in zip(rows["path"], rows["content"])]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, content string").filter("content is not null")


def messages(files: DataFrame, offset_minutes: int = 480) -> DataFrame:
    """file, content -> one row for each message; times are brought to UTC.

    Days come first unless some header of the file has a second number over 12 and none a first one. A file is the
    unit of order: its lines are numbered before they are spread.
    """
    lines = files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("line", "raw"))
    lines = lines.withColumn("raw", F.regexp_replace(F.regexp_replace("raw", "[  ]", " "), f"^{MARKS}+", ""))
    part = lambda i: F.coalesce(_part(F.col("raw"), HEADER, i), _part(F.col("raw"), HEADER, i + 7))
    heads = lines.withColumns({n: part(i + 1).try_cast("int") for i, n in enumerate(("a", "b", "year", "hour", "minute", "second"))})
    heads = heads.withColumns({"half": F.lower(part(7)), "rest": F.when(F.col("a").isNotNull(), F.regexp_extract("raw", HEADER, 15))})
    whole = Window.partitionBy("file")
    heads = heads.withColumns(
        {
            "day_first": F.max(F.col("a") > 12).over(whole) | ~F.coalesce(F.max(F.col("b") > 12).over(whole), F.lit(False)),
            "ordinal": F.count("a").over(whole.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("ordinal > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("rest", "raw").alias("t")))), lambda x: x["t"]), "\n")
    names = ["a", "b", "year", "hour", "minute", "second", "half", "day_first"]
    out = heads.groupBy("file", "ordinal").agg(text.alias("body"), *[F.max(n).alias(n) for n in names])
    hour = F.when((F.col("half") == "p") & (F.col("hour") < 12), F.col("hour") + 12).when((F.col("half") == "a") & (F.col("hour") == 12), 0).otherwise(F.col("hour"))
    day, month = F.when(F.col("day_first"), F.col("a")).otherwise(F.col("b")), F.when(F.col("day_first"), F.col("b")).otherwise(F.col("a"))
    year = F.when(F.col("year") < 100, F.col("year") + 2000).otherwise(F.col("year"))
    stamp = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, F.col("minute"), F.coalesce("second", F.lit(0)))
    ts = stamp.try_cast("timestamp_ntz") - F.make_interval(mins=F.lit(offset_minutes))
    sender = _part(F.col("body"), r"^([^:\n]{1,60}): ?", 1)
    body = F.when(sender.isNotNull(), F.regexp_replace("body", r"^[^:\n]{1,60}: ?", "")).otherwise(F.col("body"))
    bare = F.regexp_replace(body, MARKS, "")
    attachment = r"<attached: ([^>]+)>|(\S+\.(?:jpg|jpeg|png|mp4|pdf|opus|webp|vcf)) \(file attached\)"
    attached = F.array_compact(F.array(_part(bare, attachment, 1), _part(bare, attachment, 2)))
    gone = r"(?i)^(?:this message was deleted|you deleted this message)\.?$"
    clean = F.trim(F.regexp_replace(F.regexp_replace(bare, attachment, ""), r"(?i)<this message was edited>|<media omitted>|\b(?:image|video|audio|sticker|document|GIF) omitted", ""))
    return out.select(
        "file", "ordinal", ts.alias("ts"),
        F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(sender, MARKS, ""), r"^~\s*", ""), r"\s+", " ")).alias("sender"),
        clean.alias("text"), attached.alias("attachments"), bare.rlike(r"(?i)\bomitted>?$").alias("omitted"), bare.rlike(r"(?i)<this message was edited>").alias("edited"), bare.rlike(gone).alias("deleted"), sender.isNull().alias("system"),
    )
