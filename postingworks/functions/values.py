"""Workplace types, times, pay ranges and posting keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip


def workplace(raw: Column) -> Column:
    """ONSITE, HYBRID, REMOTE or UNKNOWN from a source's own word."""
    word = F.translate(F.lower(strip(F.coalesce(raw, F.lit("")))), "-_ ", "")
    return F.when(word.isin("onsite", "inoffice", "office"), "ONSITE").when(word == "hybrid", "HYBRID").when(word == "remote", "REMOTE").otherwise("UNKNOWN")


def workplace_of_phrase(raw: Column) -> Column:
    """The same from a free phrase, such as 'Flexible - hybrid'."""
    low = F.lower(raw)
    has = lambda *ws: F.coalesce(F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)), F.lit(False))
    return F.when(has("remote"), "REMOTE").when(has("flex", "hybrid"), "HYBRID").when(has("site", "office"), "ONSITE").otherwise("UNKNOWN")


def offset_time(raw: Column) -> Column:
    """An ISO-8601 time that states its offset, else null."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"), F.try_to_timestamp(raw))


def instant(raw: Column) -> Column:
    """An ISO-8601 instant with seconds and an offset, else null."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"), F.try_to_timestamp(raw))


def start_of_day(raw: Column) -> Column:
    """Midnight UTC of an ISO date, else null."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(raw))


def pay_range(currency: Column, low: Column, high: Column, interval: Column) -> Column:
    """'USD 120,000–150,000 per-year'; null unless both bounds are given."""
    none = F.lit("")
    return F.when(low.isNotNull() & high.isNotNull(), strip(F.format_string("%s %,.0f–%,.0f %s", F.coalesce(currency, none), low, high, F.coalesce(interval, none))))


def posting_key(ats: Column, external_id: Column) -> Column:
    return F.concat_ws(":", ats, external_id)


def key_parts(key: Column) -> tuple[Column, Column]:
    """ats and external id of a posting key, which is split at its first colon."""
    ats = F.substring_index(key, ":", 1)
    return ats, F.substr(key, F.length(ats) + 2)


def board_scoped_id(ats: Column, board: Column, external_id: Column) -> Column:
    """Old Workday ids, which were bare paths, with their board in front."""
    return F.when((ats == "WORKDAY") & external_id.startswith("/"), F.concat(board, external_id)).otherwise(external_id)


def joined_list(values: Column) -> Column:
    """The old storage form of a list: lines; empty is null and line ends become spaces."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.replace(v, F.lit("\n"), F.lit(" "))), "\n"))


def split_list(stored: Column) -> Column:
    """Back from the old storage form; trailing empty elements are lost."""
    kept = F.regexp_replace(stored, "\n+$", "")
    return F.when(stored.isNull() | (stored == ""), F.array().cast("array<string>")).when(kept == "", F.array().cast("array<string>")).otherwise(F.split(kept, "\n"))
