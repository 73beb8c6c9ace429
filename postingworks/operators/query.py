"""The read side: filters, ranked pages, detail, boards."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import titles
from .stats import board_summary

SUMMARY = ["id", "ats", "company", "title", "locations", "workplace_type", "department", "url", "score", "matched_skills", "first_seen_at", "closed_at", "duplicate_of_id"]


def is_open() -> Column:
    return F.col("closed_at").isNull()


def is_closed() -> Column:
    return F.col("closed_at").isNotNull()


def not_duplicate() -> Column:
    return F.col("duplicate_of_id").isNull()


def min_score(x: float) -> Column:
    return F.col("score") >= F.lit(float(x))


def first_seen_since(t: datetime) -> Column:
    return F.col("first_seen_at") >= F.lit(t)


def company_is(name: str) -> Column:
    return F.lower("company") == name.strip().lower()


def ats_is(ats: str) -> Column:
    return F.col("ats") == ats


def title_contains(q: str) -> Column:
    """Normalized titles that hold the normalized query; one that normalizes to nothing matches all."""
    return F.col("normalized_title").contains(titles.normalize_text(q))


def parse_since(raw: str | None) -> datetime | None:
    """An ISO instant, or an ISO date for its midnight UTC; blank means none."""
    if not raw or not raw.strip():
        return None
    text = raw.strip()
    try:
        if len(text) == 10:
            return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"since is an ISO instant or date, not {raw!r}") from e
    if found.tzinfo is None:
        raise ValueError(f"since needs an offset: {raw!r}")
    return found


@dataclass(frozen=True)
class Filter:
    """Supplied conditions only; by default open postings without duplicates."""

    status: str = "OPEN"
    min_score: float | None = None
    since: datetime | None = None
    company: str | None = None
    ats: str | None = None
    q: str | None = None
    include_duplicates: bool = False

    def __post_init__(self):
        if self.status not in ("OPEN", "CLOSED", "ALL"):
            raise ValueError(f"status is OPEN, CLOSED or ALL, not {self.status}")
        if self.min_score is not None and not (math.isfinite(self.min_score) and 0 <= self.min_score <= 1):
            raise ValueError("min_score is between 0 and 1")

    def condition(self) -> Column:
        parts = [{"OPEN": is_open(), "CLOSED": is_closed(), "ALL": F.lit(True)}[self.status]]
        if not self.include_duplicates:
            parts.append(not_duplicate())
        if self.min_score is not None:
            parts.append(min_score(self.min_score))
        if self.since is not None:
            parts.append(first_seen_since(self.since))
        if self.company and self.company.strip():
            parts.append(company_is(self.company))
        if self.ats is not None:
            parts.append(ats_is(self.ats))
        if self.q and self.q.strip():
            parts.append(title_contains(self.q))
        return reduce(and_, parts)


ORDERS = {
    "SCORE": lambda: [F.col("score").desc_nulls_last(), F.col("first_seen_at").desc(), F.col("id").asc()],
    "NEWEST": lambda: [F.col("first_seen_at").desc(), F.col("id").asc()],
}


def summaries(state: DataFrame) -> DataFrame:
    return state.select(SUMMARY)


def page(state: DataFrame, filter: Filter = Filter(), sort: str = "SCORE", number: int = 0, size: int = 50) -> DataFrame:
    """One page of summaries: a top-(offset + size) of pruned, filtered columns, never a full sort."""
    if number < 0 or not 1 <= size <= 200:
        raise ValueError("pages start at 0 and have 1 to 200 rows")
    found = summaries(state.where(filter.condition())).orderBy(*ORDERS[sort]())
    return found.offset(number * size).limit(size) if number else found.limit(size)


def page_totals(state: DataFrame, filter: Filter = Filter(), size: int = 50) -> DataFrame:
    """total_items and total_pages."""
    return state.where(filter.condition()).agg(F.count("*").alias("total_items")).select("total_items", F.ceil(F.col("total_items") / size).cast("long").alias("total_pages"))


def detail(state: DataFrame, id: int) -> DataFrame:
    """One posting in full, with missing skills and the ids of its duplicates; no row if there is none."""
    own = state.where(F.col("id") == id)
    copies = state.where(F.col("duplicate_of_id") == id).agg(F.array_sort(F.collect_list("id")).alias("duplicate_ids"))
    rows = own.select(*SUMMARY, "description", "compensation", "source_published_at", "last_seen_at", "skills", F.array_except("skills", "matched_skills").alias("missing_skills"), "dedup_reason")
    return rows.crossJoin(F.broadcast(copies))  # one row


def keyset_page(state: DataFrame, after_id: int, n: int = 500) -> DataFrame:
    return state.where(F.col("id") > after_id).orderBy("id").limit(n)


def boards(state: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured boards in order with postings_seen, open_postings, last_seen_at; stored boards not configured drop out."""
    joined = configured.join(board_summary(state), ["ats", "board_token"], "left")
    zero = F.lit(0).cast("long")
    return joined.select("company", "ats", "board_token", F.coalesce("postings_seen", zero).alias("postings_seen"), F.coalesce("open_postings", zero).alias("open_postings"), "last_seen_at", "cfg_pos").orderBy("cfg_pos").drop("cfg_pos")
