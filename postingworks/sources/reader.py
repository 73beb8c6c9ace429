"""Spark data source `job_boards`: one input partition per host, each yielding raw bodies or a failure row per board.

    spark.dataSource.register(JobBoards)
    spark.read.format("job_boards").options(boards=json_of_boards, mode="VIRTUAL").load()
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..config import Board, Settings
from .http import Fetcher, NotFound
from .parse import PAGE_GUARD, PAGE_SIZE, workday_token

# Where the sources answer.
BASES = {
    "GREENHOUSE": "https://boards-api.greenhouse.io", "LEVER": "https://api.lever.co", "ASHBY": "https://api.ashbyhq.com",
    "WORKDAY": "https://{tenant}.{wd}.myworkdayjobs.com", "SMARTRECRUITERS": "https://api.smartrecruiters.com",
}
MODES = ("SEQUENTIAL", "PLATFORM_POOL", "VIRTUAL")


def board_url(board: Board, bases: dict[str, str]) -> str:
    base = bases[board.ats].rstrip("/")
    if board.ats == "WORKDAY":
        tenant, wd, site = workday_token(board.token)
        return f"{base.replace('{tenant}', tenant).replace('{wd}', wd)}/wday/cxs/{tenant}/{site}"
    path = {"GREENHOUSE": "/v1/boards/{}/jobs?content=true", "LEVER": "/v0/postings/{}?mode=json", "ASHBY": "/posting-api/job-board/{}?includeCompensation=true", "SMARTRECRUITERS": "/v1/companies/{}/postings"}
    return base + path[board.ats].format(board.token)


def read_board(board: Board, pos: int, fetcher: Fetcher, bases: dict[str, str], max_details: int):
    """Rows of RAW for one board; a failure anywhere is a single row with its error. A row of kind 'retries' has in
    `place` how many requests were repeated, if any were."""
    lead = (board.ats, board.name, board.token, pos)
    before = getattr(fetcher, "retries", 0)
    rows = _read(board, lead, fetcher, bases, max_details)
    again = getattr(fetcher, "retries", 0) - before
    return [*rows, (*lead, "retries", again, None, None, None)] if again else rows


def _read(board: Board, lead: tuple, fetcher: Fetcher, bases: dict[str, str], max_details: int) -> list[tuple]:
    try:
        url = board_url(board, bases)
        if board.ats not in PAGE_SIZE:
            return [(*lead, "board", 0, None, fetcher.fetch(url), None)]
        return list(_pages(board, lead, url, fetcher, max_details))
    except Exception as e:  # the boundary between boards: one that fails never stops the others
        return [(*lead, "board", 0, None, None, f"{type(e).__name__}: {e}")]


def _pages(board: Board, lead: tuple, url: str, fetcher: Fetcher, max_details: int):
    size, offset, fetched, first_total, items = PAGE_SIZE[board.ats], 0, 0, None, {}
    list_at, total_at, ident = ("jobPostings", "total", "externalPath") if board.ats == "WORKDAY" else ("content", "totalFound", "id")
    while True:
        if board.ats == "WORKDAY":
            body = fetcher.fetch(f"{url}/jobs", json.dumps({"appliedFacets": {}, "limit": size, "offset": offset, "searchText": ""}, separators=(",", ":")))
        else:
            body = fetcher.fetch(f"{url}?limit={size}&offset={offset}")
        yield (*lead, "page", offset, None, body, None)
        page = json.loads(body)
        found = page.get(list_at) if isinstance(page, dict) else None
        if found is None:
            return
        for x in found:
            items.setdefault(x.get(ident), None)
        if first_total is None:
            first_total = page.get(total_at) if page.get(total_at) is not None else 1 << 31
        offset, fetched = offset + size, fetched + len(found)
        if len(found) < size or fetched >= first_total or fetched >= PAGE_GUARD:
            break
    for item in [i for i in list(items)[:max_details] if i is not None]:
        try:
            body = fetcher.fetch(f"{url}{item}" if board.ats == "WORKDAY" else f"{url}/{item}")
        except NotFound:
            body = None  # gone between listing and detail: the listing's own fields stand
        yield (*lead, "detail", 0, item, body, None)


class _Hosts(InputPartition):
    def __init__(self, boards: list[tuple[int, dict]]):
        self.boards = boards


class JobBoards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_boards"

    def schema(self) -> str:
        return schemas.RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._boards = [Board(**b) for b in json.loads(options["boards"])]
        self._mode = options.get("mode", "VIRTUAL").upper()
        if self._mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self._settings = Settings(**json.loads(options.get("settings", "{}")))
        self._bases = BASES | json.loads(options.get("bases", "{}"))

    def partitions(self):
        hosts: dict[str, list] = {}
        for pos, b in enumerate(self._boards):
            host = b.token.split("/")[0] if b.ats == "WORKDAY" else b.ats
            hosts.setdefault(host, []).append((pos, asdict(b)))
        groups = list(hosts.values())
        n = {"SEQUENTIAL": 1, "PLATFORM_POOL": min(self._settings.pool_size, len(groups)), "VIRTUAL": len(groups)}[self._mode]
        return [_Hosts([b for g in groups[i::n] for b in g]) for i in range(n)] if groups else []

    def read(self, partition):
        fetcher = Fetcher(self._settings)
        for pos, b in partition.boards:
            yield from read_board(Board(**b), pos, fetcher, self._bases, self._settings.max_details)
