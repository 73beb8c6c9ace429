"""Market statistics. Openings count as observed only if they came after their own board's first crawl."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import round3

_LIVE = "closed_at is null and duplicate_of_id is null"


def check_top(n: int) -> int:
    if not 1 <= n <= 100:
        raise ValueError("top is between 1 and 100")
    return n


def totals(state: DataFrame) -> DataFrame:
    """open_postings (without duplicates), closed_postings, open_duplicates."""
    is_open = F.col("closed_at").isNull()
    copy = F.col("duplicate_of_id").isNotNull()
    return state.agg(F.count_if(is_open & ~copy).alias("open_postings"), F.count_if(~is_open).alias("closed_postings"), F.count_if(is_open & copy).alias("open_duplicates"))


def open_by(state: DataFrame, column: str) -> DataFrame:
    """Open postings per value, most first."""
    return state.where(_LIVE).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def top_companies(state: DataFrame, n: int = 10) -> DataFrame:
    return state.where(_LIVE).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(check_top(n))


def skill_demand(state: DataFrame, dictionary: DataFrame, n: int = 10) -> DataFrame:
    """skill, category, postings, share of the open postings; lists with no skills count in the denominator."""
    live = state.where(_LIVE)
    counts = live.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("postings"))
    top = counts.orderBy(F.desc("postings"), "skill").limit(check_top(n))
    total = live.agg(F.count("*").alias("total"))
    named = top.join(F.broadcast(dictionary.select(F.lower("skill").alias("low"), "category")), F.lower("skill") == F.col("low"), "left")  # the dictionary: a few dozen rows
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("postings") / F.col("total"))
    return named.crossJoin(F.broadcast(total)).select("skill", "category", "postings", round3(share).alias("share")).orderBy(F.desc("postings"), "skill")


def observed(state: DataFrame) -> DataFrame:
    """Postings first seen after their board's first crawl, by a pre-aggregated join instead of a window over boards."""
    first = state.groupBy("ats", "board_token").agg(F.min("first_seen_at").alias("_first"))
    return state.join(first, ["ats", "board_token"]).where("first_seen_at > _first").drop("_first")


def board_summary(state: DataFrame) -> DataFrame:
    """ats, board_token, postings_seen, open_postings, last_seen_at."""
    return state.groupBy("ats", "board_token").agg(F.count("*").alias("postings_seen"), F.count_if(F.col("closed_at").isNull()).alias("open_postings"), F.max("last_seen_at").alias("last_seen_at"))


def fetched_by_ats(postings: DataFrame) -> DataFrame:
    """Postings fetched of each source, before ids of a board are made unique."""
    return postings.groupBy("ats").agg(F.count("*").alias("n"))


def exact_percentiles(seconds: DataFrame, at: list[float]) -> DataFrame:
    """One row from a column `s` of whole seconds: n, and p0, p1, ... (null if n is 0), linearly interpolated between ranks.

    Values are counted by day, then by second within each day: the running sum over days has a row a day and the ones
    over seconds 86,400 rows at most, so no task holds or sorts all values."""
    counts = seconds.where("s is not null").groupBy(F.floor(F.col("s") / 86400).alias("day"), "s").agg(F.count("*").alias("k"))
    days = counts.groupBy("day").agg(F.sum("k").alias("k"))
    before = days.select("day", (F.sum("k").over(Window.orderBy("day")) - F.col("k")).alias("before"))
    own = Window.partitionBy("day").orderBy("s")
    ranked = counts.join(before, "day").select("s", (F.col("before") + F.sum("k").over(own)).alias("upto"), "k")
    total = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n"))
    near = ranked.crossJoin(F.broadcast(total))  # one row
    place = [(F.col("n").cast("double") - 1) * F.lit(p) for p in at]
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("k") <= rank)
    picked = near.groupBy("n").agg(*[F.max(F.when(holds(f(x)), F.col("s"))).alias(f"{name}{i}") for i, x in enumerate(place) for name, f in (("low", F.floor), ("high", F.ceil))])
    value = lambda i, x: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (x - F.floor(x))
    found = picked.select(F.col("n").alias("_n"), *[value(i, x).alias(f"p{i}") for i, x in enumerate(place)])
    return total.join(found, F.col("n") == F.col("_n"), "left").drop("_n")


def time_to_close(state: DataFrame) -> DataFrame:
    """observed_closures, median_days, p75_days (null if none); duplicates count too."""
    seconds = F.unix_seconds(F.col("closed_at").cast("timestamp")) - F.unix_seconds(F.col("first_seen_at").cast("timestamp"))
    lean = observed(state.select("ats", "board_token", "first_seen_at", "closed_at")).where("closed_at is not null")
    both = exact_percentiles(lean.select(seconds.alias("s")), [0.5, 0.75])
    return both.select(F.col("n").alias("observed_closures"), round3(F.col("p0") / 86400.0).alias("median_days"), round3(F.col("p1") / 86400.0).alias("p75_days"))


def new_openings(state: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Observed openings since then, closed ones and duplicates included."""
    recent = observed(state.select("ats", "board_token", "first_seen_at")).where(F.col("first_seen_at") > F.lit(now - timedelta(days=days)))
    return recent.agg(F.count("*").alias("new_openings"))


def crawl_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.min("started_at").alias("first_run_at"), F.max("started_at").alias("last_run_at"), F.max_by("companies_requested", "started_at").alias("last_run_boards"))


def stats(state: DataFrame, runs: DataFrame, dictionary: DataFrame, now: datetime, top: int = 10) -> dict:
    """Everything as one nested dict, from small results only: `top` rows or one row for each source or workplace type."""
    check_top(top)
    one = lambda df: df.first().asDict()
    return {
        **one(totals(state)),
        "open_by_ats": {r[0]: r[1] for r in open_by(state, "ats").collect()},
        "open_by_workplace": {r[0]: r[1] for r in open_by(state, "workplace_type").collect()},
        "top_companies": [r.asDict() for r in top_companies(state, top).collect()],
        "top_skills": [r.asDict() for r in skill_demand(state, dictionary, top).collect()],
        "time_to_close": one(time_to_close(state)), "new_last_7_days": one(new_openings(state, now))["new_openings"], "crawl": one(crawl_summary(runs)),
    }


class StatsCache:
    """Results by (state version, top), dropped when the version changes; `drop` is what a store calls on a commit."""

    def __init__(self):
        self._version, self._held = None, {}

    def drop(self, version=None) -> None:
        self._version, self._held = version, {}

    def get(self, version, top: int, compute):
        if version != self._version:
            self._version, self._held = version, {}
        if top not in self._held:
            self._held[top] = compute()
        return self._held[top]
