"""Pairs of same-company postings by stratum, and a deterministic stratified sample with inverse-probability weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import titles
from ..functions.text import jaccard
from .dedup import features, fuzzy_match

FLOOR = 0.5
BANDS = ["near_0.9", "near_0.7", "near_0.5"]
STRATA = ["predicted", *BANDS]


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.9, BANDS[0]).when(similarity >= 0.7, BANDS[1]).when(similarity >= FLOOR, BANDS[2])


def company_pairs(postings: DataFrame, threshold: float = 1.0, floor: float = FLOOR) -> DataFrame:
    """(company_key, a_id, b_id, title_similarity, stratum): pairs of one company, a before b, whose titles share at least
    `floor` of their words, by prefix filtering: with words from rare to common, two titles that similar share a word of
    their first n - ceil(floor n) + 1, so common words alone never bring a pair together. Titles without words are equal."""
    f = features(postings).select("company_key", "id", titles.tokens(F.col("title")).alias("tokens"), F.struct("company_key", "signature", "levels", "place_keys", "department_key").alias("f"))
    words = f.select("company_key", "id", F.size("tokens").alias("n"), F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("w"))
    often = words.groupBy("company_key", "w").agg(F.count("*").alias("often"))
    ordered = words.join(often, ["company_key", "w"]).groupBy("company_key", "id").agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("ws"), F.first("n").alias("n"))
    length = F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(floor)) + 1).cast("int")
    prefix = ordered.select("company_key", "id", F.explode(F.slice("ws", F.lit(1), length)).alias("p")).select("company_key", "id", "p.w")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col("a.company_key") == F.col("b.company_key")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id")))
    pairs = met.select(F.col("a.company_key").alias("company_key"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).distinct()
    side = lambda x: f.select(F.col("id").alias(f"{x}_id"), F.col("tokens").alias(f"t{x}"), F.col("f").alias(f"f{x}"))
    near = pairs.join(side("a"), "a_id").join(side("b"), "b_id").withColumn("title_similarity", jaccard(F.col("ta"), F.col("tb"))).where(F.col("title_similarity") >= floor)
    predicted = fuzzy_match(F.col("fa"), F.col("fb"), threshold)
    return near.select("company_key", "a_id", "b_id", "title_similarity", F.when(predicted, STRATA[0]).otherwise(band(F.col("title_similarity"))).alias("stratum"))


def without_pairs(pairs: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs that aren't among earlier ones, in either order; both have a_id and b_id."""
    both = lambda: F.array_sort(F.array("a_id", "b_id"))
    return pairs.withColumn("_p", both()).join(earlier.select(both().alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def quotas(predicted: int = 50, near: int = 50) -> dict[str, int]:
    """The near-miss budget is split evenly, the remainder to higher bands."""
    return {STRATA[0]: predicted} | {b: near // len(BANDS) + (i < near % len(BANDS)) for i, b in enumerate(BANDS)}


def stratified_sample(pairs: DataFrame, predicted: int = 50, near: int = 50, seed: int = 42) -> DataFrame:
    """Rows of each stratum in the order of a seeded hash, with weight = population / sample of their stratum. The sizes are
    the feature; weights count every pair."""
    sizes = pairs.groupBy("stratum").agg(F.count("*").alias("population"))
    quota = F.create_map(*[F.lit(x) for kv in quotas(predicted, near).items() for x in kv])
    order = F.xxhash64("a_id", "b_id", F.lit(seed))
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(order, "a_id", "b_id"))
    # The literal bound first: with it every task keeps that many rows of a stratum before they are shuffled.
    top = pairs.withColumn("_nth", nth).where(F.col("_nth") <= max(quotas(predicted, near).values()))
    chosen = top.where(F.col("_nth") <= F.try_element_at(quota, F.col("stratum"))).drop("_nth")
    return chosen.join(F.broadcast(sizes), "stratum").withColumn("weight", F.col("population") / F.least("population", F.try_element_at(quota, F.col("stratum")))).drop("population")  # four rows
