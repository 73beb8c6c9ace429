"""Quality of duplicate links on labelled pairs: weighted confusion, precision with its interval, threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959964


def predicts(url_a: Column, url_b: Column, fuzzy: Column) -> Column:
    return url_a.eqNullSafe(url_b) | fuzzy


def confusion(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall from (duplicate, predicted, weight); rows without a label don't count."""
    rows = labelled.where("duplicate is not null")
    d, p, zero = F.col("duplicate"), F.col("predicted"), F.lit(0.0)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight").cast("double")).otherwise(zero)), zero)
    sums = rows.groupBy(*(by or [])).agg(total(d & p).alias("tp"), total(~d & p).alias("fp"), total(d & ~p).alias("fn"), total(~d & ~p).alias("tn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, F.lit(float("nan"))).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return sums.select(*(by or []), "tp", "fp", "fn", "tn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval, clamped to [0, 1]; NaN for n = 0."""
    count = F.when(n == 0, None).otherwise(n).cast("double")
    p, z2 = successes / count, Z95 * Z95
    scale = F.lit(1.0) + z2 / count
    centre = (p + z2 / (count * 2)) / scale
    margin = F.sqrt(p * (F.lit(1.0) - p) / count + z2 / (count * count * 4.0)) * Z95 / scale
    nan = F.lit(float("nan"))
    return F.when(n == 0, nan).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(n == 0, nan).otherwise(F.least(F.lit(1.0), centre + margin))


def predicted_precision(labelled: DataFrame) -> DataFrame:
    """labelled, correct, precision, low, high of the stratum 'predicted'."""
    rows = labelled.where("duplicate is not null and stratum = 'predicted'").agg(F.count("*").alias("labelled"), F.count_if("duplicate").alias("correct"))
    low, high = wilson(F.col("correct"), F.col("labelled"))
    share = F.when(F.col("labelled") == 0, F.lit(float("nan"))).otherwise(F.col("correct") / F.col("labelled"))
    return rows.select("labelled", "correct", share.alias("precision"), low.alias("low"), high.alias("high"))


def sweep(labelled: DataFrame, thresholds: list[float], predicted) -> DataFrame:
    """threshold, precision, recall; predicted(threshold column) is whether a row is predicted a duplicate at it. The
    thresholds are given, so each row is expanded into that many, not joined with other rows."""
    each = labelled.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return confusion(each.withColumn("predicted", predicted(F.col("threshold"))), ["threshold"]).select("threshold", "precision", "recall")


def median_of_runs(runs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median of measured integers, the mean of the two middle ones rounded down."""
    return runs.groupBy(*by).agg(F.floor(F.percentile(value, F.lit(0.5))).cast("long").alias("median"))
