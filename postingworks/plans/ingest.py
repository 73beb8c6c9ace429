"""One ingest run end to end: raw bodies, snapshots, sync, scores, links, audit row; and the versioned store of postings.

A version is a directory of Parquet; a run reads one, writes the next beside it and its audit row under the number that
it will have, and then gives the directory its name. So a run that fails leaves the store as it was, a version never is
without its audit row, and a reader's version never changes under it. Audit rows of numbers without a version, which
failed runs leave, don't count and are replaced by the next run.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..config import Board, Profile, Settings, SkillDictionary
from ..operators import dedup, lifecycle, scoring, stats
from ..sources import parse


class AlreadyRunning(RuntimeError):
    pass


#: Audit rows as they are stored: with what a stream calls the batch that the run was made of.
_RUN = f"{schemas.INGEST_RUN}, batch string"


class Store:
    """Postings and runs under one folder of any file system that Spark knows. on_commit is called with the number of
    each version that this process commits, whatever fails later in the run. A lock that is older than `stale_seconds`
    belongs to a run that died and is taken over."""

    def __init__(self, spark: SparkSession, root: str, on_commit: Callable[[int], None] | None = None, stale_seconds: float = 6 * 3600):
        self._spark, self._root, self._on_commit, self._stale = spark, root.rstrip("/"), on_commit, stale_seconds

    def _fs(self, path: str):
        p = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        fs, p = self._fs(f"{self._root}/versions")
        if not fs.exists(p):
            return 0
        return max([int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v") and self._exists(f"{self._root}/versions/{s.getPath().getName()}/_SUCCESS")], default=0)

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def postings(self, board: Board | None = None) -> DataFrame:
        """All stored postings, or those of one board: of its source's partition, files hold boards in order, so that
        the others are skipped by their statistics."""
        v = self.version()
        rows = self._spark.read.schema(schemas.STATE).parquet(f"{self._root}/versions/v{v}") if v else lifecycle.empty_state(self._spark)
        return rows if board is None else rows.where((F.col("ats") == board.ats) & (F.col("board_token") == board.token))

    def stage_version(self, state: DataFrame) -> str:
        """Write a version, partitioned by source and in the order of boards, that no reader sees yet."""
        path = f"{self._root}/versions/writing-{uuid.uuid4().hex}"
        state.select([f.split()[0] for f in schemas.STATE.split(", ")]).sortWithinPartitions("ats", "board_token").write.partitionBy("ats").parquet(path)
        return path

    def commit(self, staged: str, run: tuple, batch: str | None = None) -> int:
        """Make a staged version the next one, with its audit row (without its id, which is the version's number)."""
        v = self.version() + 1
        self._spark.createDataFrame([(v, *run, batch)], _RUN).coalesce(1).write.mode("overwrite").parquet(f"{self._root}/runs/run={v}")
        fs, old = self._fs(staged)
        _, new = self._fs(f"{self._root}/versions/v{v}")
        if fs.exists(new) or not fs.rename(old, new):
            raise OSError(f"could not commit version {v}")
        if self._on_commit:
            self._on_commit(v)
        return v

    def _committed(self) -> DataFrame:
        v = self.version()
        if not v:
            return self._spark.createDataFrame([], f"{_RUN}, run int")
        return self._spark.read.schema(f"{_RUN}, run int").parquet(f"{self._root}/runs").where(F.col("run") <= v)

    def runs(self) -> DataFrame:
        return self._committed().drop("batch", "run")

    def has_batch(self, batch: str) -> bool:
        """If a version was made of this batch of a stream."""
        return not self._committed().where(F.col("batch") == batch).isEmpty()

    def staging(self):
        """A function that writes a table of this run and reads it back, and one that deletes all of them.

        Bodies are fetched once even if executors are lost, and plans stay short: those of cached tables grow with every
        step, and their analysis took most of a small run."""
        root = f"{self._root}/staging/{uuid.uuid4().hex}"

        def stage(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{root}/{name}")
            return self._spark.read.schema(df.schema).parquet(f"{root}/{name}")

        def clear() -> None:
            fs, p = self._fs(root)
            fs.delete(p, True)

        return stage, clear

    def lock(self):
        """Single flight: the file is created by one run at a time; the run that dies leaves it to one that comes later."""
        fs, p = self._fs(f"{self._root}/running.lock")
        owner = uuid.uuid4().hex
        try:
            self._create_lock(fs, p, owner)
        except Exception as e:
            held = self._held_lock(fs, p)
            if held and time.time() - held["at"] < self._stale:
                raise AlreadyRunning(f"an ingest run is in progress since {datetime.fromtimestamp(held['at'], timezone.utc)}") from e
            # Of several that see the dead run's lock one moves it away, and that one alone may create its own.
            _, aside = self._fs(f"{self._root}/dead-{owner}.lock")
            if not fs.rename(p, aside):
                raise AlreadyRunning("another run has taken the lock over") from e
            fs.delete(aside, False)
            self._create_lock(fs, p, owner)

        def unlock() -> None:
            held = self._held_lock(fs, p)
            if held and held["owner"] == owner:
                fs.delete(p, False)

        return unlock

    def _create_lock(self, fs, p, owner: str) -> None:
        out = fs.create(p, False)
        out.write(json.dumps({"owner": owner, "at": time.time()}).encode())
        out.close()

    def _held_lock(self, fs, p) -> dict | None:
        """Owner and time of the lock; one without them, of a run that died at once, is as old as its file."""
        if not fs.exists(p):
            return None
        try:
            data = fs.open(p)
            raw = bytes(data.readAllBytes())
            data.close()
            return json.loads(raw)
        except Exception:
            return {"owner": None, "at": fs.getFileStatus(p).getModificationTime() / 1000}


@dataclass
class Report:
    started_at: datetime
    mode: str
    companies_requested: int
    companies_succeeded: int = 0
    failures: list[dict] = field(default_factory=list)
    incomplete_boards: list[dict] = field(default_factory=list)
    postings_fetched: int = 0
    postings_by_ats: dict[str, int] = field(default_factory=dict)
    sync: dict[str, int] = field(default_factory=dict)
    dedup: dict[str, int] = field(default_factory=dict)
    retries: int = 0
    fetch_ms: int = 0
    persist_ms: int = 0
    wall_ms: int = 0
    version: int = 0

    def as_json(self) -> str:
        return json.dumps(asdict(self), default=str)


def ingest(store: Store, raw: DataFrame, boards: list[Board], now: datetime, dictionary: SkillDictionary | None = None, profile: Profile | None = None, settings: Settings = Settings(), mode: str = "VIRTUAL", batch: str | None = None) -> Report:
    """raw: the bodies of these boards, from the reader or a recording. Boards that failed keep their stored rows; links are
    recomputed over all open postings. What is collected is a row a board or a source. Of the run's times, fetching ends
    when all bodies are staged, and persisting is what follows the parsing, to the staged version. batch: see Store."""
    unlock = store.lock()
    stage, clear = store.staging()
    try:
        begun = time.monotonic()
        raw = stage(raw, "raw")
        fetched = time.monotonic()
        postings, verdicts = parse.snapshot(raw)
        postings, verdicts = stage(postings, "postings"), stage(verdicts, "verdicts")
        parsed = time.monotonic()
        # One id on two boards of a source breaks storage's key: the board that comes later fails.
        state = store.postings()
        clash = _clashing_boards(state, postings)
        ok = verdicts.where("ok").join(clash, ["ats", "board_token"], "left_anti")
        good = postings.join(ok.select("ats", "board_token"), ["ats", "board_token"], "left_semi")
        synced = lifecycle.sync(state, good, ok, now)
        if profile is not None:
            synced = scoring.score_changed(synced, scoring.keyword_scorer(dictionary or SkillDictionary(), profile))
        synced = stage(synced, "synced")
        links = stage(dedup.dedupe(dedup.open_candidates(synced), settings.title_similarity), "links")
        staged = store.stage_version(dedup.with_links(synced.drop("change"), links))
        report = Report(now, mode, len(boards))
        report.failures = [r.asDict() for r in verdicts.where("not ok").select("company", "board_token", "ats", "error").collect()]
        report.failures += [r.asDict() | {"error": "the board repeats ids of another board"} for r in verdicts.join(clash, ["ats", "board_token"], "left_semi").select("company", "board_token", "ats").collect()]
        report.incomplete_boards = [r.asDict() for r in ok.where("not complete").select("board_token", "ats", "reason").collect()]
        report.retries = raw.where("kind = 'retries'").agg(F.coalesce(F.sum("place"), F.lit(0))).first()[0]
        report.companies_succeeded = len(boards) - len(report.failures)
        report.postings_by_ats = {r["ats"]: r["n"] for r in stats.fetched_by_ats(postings).collect()}
        report.postings_fetched = sum(report.postings_by_ats.values())
        report.sync = lifecycle.total_counts(lifecycle.sync_counts(synced)).first().asDict()
        by_reason = {r["reason"]: r["count"] for r in links.groupBy("reason").count().collect()}
        report.dedup = {"open_postings": synced.where("closed_at is null").count(), "exact_duplicates": by_reason.get("EXACT_URL", 0), "fuzzy_duplicates": by_reason.get("FUZZY", 0)}
        done = time.monotonic()
        report.fetch_ms, report.persist_ms, report.wall_ms = (int(1000 * x) for x in (fetched - begun, done - parsed, done - begun))
        s = report.sync
        report.version = store.commit(staged, (now, mode, len(boards), report.companies_succeeded, report.postings_fetched, s["created"], s["updated"], s["reopened"], s["closed"], report.fetch_ms, report.persist_ms, report.wall_ms), batch)
        return report
    finally:
        try:
            clear()
        finally:
            unlock()


def _clashing_boards(state: DataFrame, postings: DataFrame) -> DataFrame:
    """Boards of this run with an id that a stored board or an earlier board of the run has."""
    stored = state.select("ats", "external_id", F.col("board_token"), F.lit(-1).alias("cfg_pos"))
    seen = stored.union(postings.select("ats", "external_id", "board_token", "cfg_pos").distinct())
    owner = seen.groupBy("ats", "external_id").agg(F.min_by("board_token", F.struct("cfg_pos", "board_token")).alias("owner"), F.count_distinct("board_token").alias("n")).where("n > 1")
    late = postings.select("ats", "external_id", "board_token").distinct().join(owner, ["ats", "external_id"]).where("board_token <> owner")
    return late.select("ats", "board_token").distinct()


def crawl(store: Store, boards: list[Board], now: datetime, profile: Profile, settings: Settings = Settings(), mode: str = "VIRTUAL") -> int:
    """One live crawl: exit code 0 if a board at least succeeded, 1 otherwise or if a run is in progress."""
    from ..sources.reader import JobBoards

    spark = store._spark
    spark.dataSource.register(JobBoards)
    options = {"boards": json.dumps([asdict(b) for b in boards]), "mode": mode, "settings": json.dumps(asdict(settings))}
    try:
        report = ingest(store, spark.read.format("job_boards").options(**options).load(), boards, now, profile=profile, settings=settings, mode=mode)
    except AlreadyRunning:
        return 1
    print(report.as_json())
    return 0 if report.companies_succeeded else 1
