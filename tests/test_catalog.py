"""Every query gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postingworks.plans import catalog, views
from postingworks.sources import parse


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(name, small, same_as_sql):
    same_as_sql(catalog.queries()[name], catalog.oracle_sql()[name], small)


def test_page_text(spark, small):
    rows = catalog.queries()["page_text"](spark, small).collect()
    assert rows and all("<p" not in r.text and "track(" not in r.text for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50


def test_crawl_days_are_of_the_nearest_second_and_unknown_ones_stay(spark, small, same_as_sql, tmp_path):
    """Half a second before midnight is of the next day; halves go to the even second, as in the SQL."""
    import duckdb

    for p in Path(small).iterdir():
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "events.parquet").unlink()
    times = ["2024-01-01 23:59:59.4", "2024-01-01 23:59:59.5", "2024-01-02 23:59:59.7", "2024-01-04 00:00:00.5", "2024-01-04 23:59:59.500001", "1969-12-30 23:59:59.9", "2024-01-06 12:00:00"]
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', {i % 2}, 'view', 1.0, '')" for i, t in enumerate(times)) + ", (7, NULL, 1, 'view', 1.0, ''), (8, TIMESTAMP '2024-01-02', 0, NULL, 1.0, ''), (9, TIMESTAMP '2024-01-05', 0, NULL, 1.0, '')"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) e(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    same_as_sql(catalog.queries()["lifecycle_history"], catalog.oracle_sql()["lifecycle_history"], str(tmp_path))


@pytest.mark.parametrize("name", ["greenhouse_postings", "ashby_postings", "lever_postings"])
def test_boards_are_recorded_in_parts(name, spark, small, same_as_sql, monkeypatch):
    """A body holds the postings of a fixed range of ids, so none grows with the tables."""
    seen, whole = [], parse.snapshot
    monkeypatch.setattr(views, "PART", 16, raising=False)
    monkeypatch.setattr(parse, "snapshot", lambda raw, *a: seen.append(raw) or whole(raw, *a))
    same_as_sql(catalog.queries()[name], catalog.oracle_sql()[name], small)
    bodies = seen[0].groupBy("board_token").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places")).collect()
    assert all(r.n == r.places > 1 for r in bodies)
    items = F.size(F.coalesce(F.from_json("body", "array<string>"), F.from_json("body", "jobs array<string>")["jobs"]))
    assert seen[0].agg(F.max(items)).first()[0] <= 16
