"""Exports of open postings: lines of JSON written by all executors, or one JSON array for small results."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .query import SUMMARY, Filter

#: camelCase names of the exported summary.
NAMES = {c: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(c.split("_"))) for c in SUMMARY}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def iso_instant(t: Column) -> Column:
    """ISO-8601 in UTC with as many fraction digits (0, 3 or 6) as are needed."""
    full = F.date_format(t, ISO)
    return F.when(full.endswith(".000000Z"), F.regexp_replace(full, r"\.000000Z$", "Z")).when(full.rlike(r"000Z$"), F.regexp_replace(full, "000Z$", "Z")).otherwise(full)


def export_rows(state: DataFrame, min_score: float | None = None, since: datetime | None = None) -> DataFrame:
    """(id, json): one object a posting, nulls kept: {"posting": {...}, "description": ..., "compensation": ...}."""
    rows = state.where(Filter(min_score=min_score, since=since).condition())
    fields = [(iso_instant(F.col(c)) if c.endswith("_at") else F.col(c)).alias(NAMES[c]) for c in SUMMARY]
    body = F.struct(F.struct(*fields).alias("posting"), "description", "compensation")
    return rows.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_ndjson(state: DataFrame, path: str, min_score: float | None = None, since: datetime | None = None) -> int:
    """Lines ordered by id over all part files, written beside the target and then renamed; returns how many."""
    rows = export_rows(state, min_score, since)
    n = rows.count()
    partial = path.rstrip("/") + ".partial"
    rows.repartitionByRange(max(1, -(-n // 1_000_000)), "id").sortWithinPartitions("id").select("json").write.mode("overwrite").text(partial)
    _rename(state.sparkSession, partial, path)
    return n


def write_array(state: DataFrame, path: str, min_score: float | None = None, since: datetime | None = None) -> int:
    """One array in one file, for results that one task can stream: lines between brackets, commas after all but the last."""
    rows = export_rows(state, min_score, since)
    n = rows.count()
    last = rows.agg(F.max("id")).first()[0]
    lines = rows.select("id", F.when(F.col("id") == F.lit(last), F.col("json")).otherwise(F.concat("json", F.lit(","))).alias("value"))
    ends = rows.sparkSession.createDataFrame([(-(1 << 63), "["), ((1 << 63) - 1, "]")], "id long, value string")
    partial = path.rstrip("/") + ".partial"
    lines.select(F.col("id").cast("long").alias("id"), "value").union(ends).coalesce(1).sortWithinPartitions("id").select("value").write.mode("overwrite").text(partial)
    _replace_file(rows.sparkSession, partial, path)
    return n


def _replace_file(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the only part file of a folder over `path` in one step; the folder goes."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old, new = hadoop.Path(folder), hadoop.Path(path)
    fs = old.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(old) if s.getPath().getName().startswith("part-"))
    how = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.OVERWRITE.getClass(), 1)
    spark._jvm.java.lang.reflect.Array.set(how, 0, hadoop.Options.Rename.OVERWRITE)
    hadoop.FileContext.getFileContext(old.toUri() if old.toUri().getScheme() else fs.getUri(), conf).rename(part, new, how)
    fs.delete(old, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Puts a folder in the place of another, which is moved aside first and only deleted when the new one is there; it
    comes back if that fails. A folder can't be replaced in one step, so readers may find none for a moment."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, b, aside = hadoop.Path(old), hadoop.Path(new), hadoop.Path(f"{new.rstrip('/')}.replaced-{uuid.uuid4().hex}")
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(b) and fs.rename(b, aside)
    try:  # some file systems say no, others raise
        if not fs.rename(a, b):
            raise OSError("not moved")
    except Exception as e:
        if had:
            fs.rename(aside, b)
        raise OSError(f"could not move {old} to {new}") from e
    if had:
        fs.delete(aside, True)
