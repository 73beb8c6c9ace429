"""Command line: one crawl or one every day, and exports.

    python -m postingworks crawl  --store DIR --boards boards.json [--profile profile.json] [--only TOKEN ...] [--daily 07:00]
    python -m postingworks export --store DIR --out PATH [--min-score X] [--since TIME] [--array]

The exit code is 0 if a board at least succeeded or the export was written, else 1.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from . import config
from .operators import export, query
from .plans.ingest import Store, crawl


def next_run(now: datetime, at: str) -> datetime:
    """The next time of day HH:MM in UTC after now."""
    hour, minute = map(int, at.split(":"))
    today = now.astimezone(timezone.utc).replace(hour=hour, minute=minute, second=0, microsecond=0)
    return today if today > now else today + timedelta(days=1)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def every_day(at: str, run: Callable[[], int], clock: Callable[[], datetime] = _now, sleep: Callable[[float], None] = time.sleep, days: int | None = None) -> int:
    """Runs at this time of each day, for so many days or for ever; a run that fails or finds another one going on is
    skipped. The last run's code."""
    code, done = 1, 0
    while days is None or done < days:
        sleep((next_run(clock(), at) - clock()).total_seconds())
        code, done = run(), done + 1
    return code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="postingworks")
    commands = parser.add_subparsers(dest="command", required=True)
    c, e = commands.add_parser("crawl"), commands.add_parser("export")
    for p in (c, e):
        p.add_argument("--store", required=True)
    c.add_argument("--boards", required=True)
    c.add_argument("--profile", default="profile.json")
    c.add_argument("--only", nargs="*")
    c.add_argument("--mode", default="VIRTUAL")
    c.add_argument("--daily")
    e.add_argument("--out", required=True)
    e.add_argument("--min-score", type=float)
    e.add_argument("--since")
    e.add_argument("--array", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    try:
        if args.command == "export":
            write = export.write_array if args.array else export.write_ndjson
            print(write(store.postings(), args.out, args.min_score, query.parse_since(args.since)))
            return 0
        boards = config.resolve_boards(args.only, config.load_boards(args.boards))
        profile = config.SkillDictionary().validated(config.load_profile(args.profile))
        run = lambda: crawl(store, boards, _now(), profile, mode=args.mode)
        return every_day(args.daily, run) if args.daily else run()
    except ValueError as x:
        print(x, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
