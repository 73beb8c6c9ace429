"""Labelled pairs as CSV with RFC 4180 quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.text import strip, strings
from ..functions.values import key_parts

_READ = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False, "mode": "FAILFAST", "nullValue": "\u0000", "emptyValue": ""}


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The CSV with parsed keys and label (duplicate: true, false or null); a wrong header or label is an error."""
    raw = spark.read.options(**_READ).schema(", ".join(f"{c} string" for c in schemas.PAIRS)).csv(path)
    word = F.lower(strip(F.coalesce("label", F.lit(""))))
    wrong = F.raise_error(F.concat(F.lit("a label is dup or distinct, not "), F.col("label")))
    duplicate = F.when(word == "dup", True).when(word == "distinct", False).when(word != "", wrong.cast("boolean"))
    out = raw.withColumns({"duplicate": duplicate, "weight": F.col("weight").cast("double"), "title_similarity": F.col("title_similarity").cast("double")})
    for side in "ab":
        ats, ext = key_parts(F.col(f"{side}_key"))
        places = F.when(F.coalesce(f"{side}_locations", F.lit("")) == "", strings([])).otherwise(F.split(f"{side}_locations", r" \| "))
        out = out.withColumns({f"{side}_ats": ats, f"{side}_external_id": ext, f"{side}_locations": places, f"{side}_department": F.when(F.col(f"{side}_department") != "", F.col(f"{side}_department"))})
    return out


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The same columns back: locations joined by ' | ', numbers with four decimals, null texts empty."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    columns = []
    for c in schemas.PAIRS:
        if c in ("weight", "title_similarity"):
            columns.append(four(c).alias(c))
        elif c in ("a_locations", "b_locations"):
            columns.append(F.array_join(c, " | ").alias(c))
        elif c == "label":
            columns.append(F.when(F.col("duplicate"), "dup").when(~F.col("duplicate"), "distinct").otherwise("").alias(c))
        else:
            columns.append(F.coalesce(F.col(c), F.lit("")).alias(c))
    pairs.select(columns).coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)
