"""Sources, ingest, duplicates, exports and HTTP over small recordings of our own."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from postingworks import config, schemas
from postingworks.operators import dedup, evaluate, export, lifecycle, query, stats
from postingworks.plans.ingest import AlreadyRunning, Store, ingest
from postingworks.sources import http, pairs, parse, reader

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def raw_of(spark, *rows):
    return spark.createDataFrame([(r.get("ats"), r.get("company", "Acme"), r.get("token", "acme"), r.get("pos", 0), r.get("kind", "board"), r.get("place", 0), r.get("item"), r.get("body"), r.get("error")) for r in rows], schemas.RAW)


def job(i, title="Engineer", **more):
    return {"id": i, "title": title, "absolute_url": f"https://x.example/{i}", "location": {"name": "Remote - US"}, "departments": [{"name": " "}, {"name": "Eng"}], "updated_at": "2026-01-01T00:00:00-05:00", "content": "&lt;p&gt;Java&lt;/p&gt;", "extra": 1} | more


def test_single_body_sources(spark):
    lever = [{"id": "l1", "text": "Dev", "hostedUrl": "https://l.example/1", "createdAt": 1000, "categories": {"location": "Berlin", "team": "T"}, "workplaceType": "on-site", "descriptionPlain": " a ", "lists": [{"text": "Need", "content": "<li>b</li>"}], "additionalPlain": " ", "salaryRange": {"min": 1, "max": 2}}]
    ashby = {"jobs": [{"id": "a1", "title": "Dev", "jobUrl": "https://a.example/1", "location": "Paris", "secondaryLocations": [{"location": " "}, {"location": "Rome"}], "isRemote": True, "isListed": True, "descriptionHtml": "<p>x</p>"}, {"id": "a2", "title": "Hidden", "jobUrl": "https://a.example/2", "isListed": False}]}
    raw = raw_of(
        spark, {"ats": "GREENHOUSE", "body": json.dumps({"jobs": [job(1), job(2, " ")]})}, {"ats": "LEVER", "body": json.dumps(lever)}, {"ats": "ASHBY", "body": json.dumps(ashby)},
        {"ats": "GREENHOUSE", "token": "bad", "body": "<html>"}, {"ats": "GREENHOUSE", "token": "empty", "body": '{"jobs": []}'}, {"ats": "LEVER", "token": "down", "error": "boom"},
    )
    good, boards = parse.snapshot(raw)
    p = {r.external_id: r for r in good.collect()}
    assert set(p) == {"1", "l1", "a1"}
    assert (p["1"].workplace_type, p["1"].department, p["1"].description, p["1"].locations) == ("REMOTE", "Eng", "Java", ["Remote - US"])
    assert (p["l1"].description, p["l1"].compensation, p["l1"].workplace_type, p["l1"].department) == ("a\nNeed b", "1–2", "ONSITE", "T")
    assert (p["a1"].locations, p["a1"].workplace_type, p["a1"].description) == (["Paris", "Rome"], "REMOTE", "x")
    b = {(r.ats, r.board_token): r for r in boards.collect()}
    assert (b["GREENHOUSE", "acme"].complete, b["GREENHOUSE", "acme"].reason) == (False, "1 postings could not be parsed")
    assert b["ASHBY", "acme"].complete and b["GREENHOUSE", "empty"].complete
    assert not b["GREENHOUSE", "bad"].ok and b["LEVER", "down"].error == "boom"


def test_lever_sections_stay_in_their_row(spark):
    section = lambda text, content: {"text": text, "content": content}
    item = lambda i, lists: {"id": f"l{i}", "text": "Dev", "hostedUrl": f"https://l.example/{i}", "descriptionPlain": "a", "lists": lists}
    items = [item(1, [section("B", "<li>b</li><li>c</li>"), section(None, "<p>d</p>"), section("E", None)]), item(2, []), item(3, None), item(4, [None, section(" ", "")])]
    raw = raw_of(spark, {"ats": "LEVER", "body": json.dumps(items)})
    good = parse.lever(raw)[0]
    assert {r.external_id: r.description for r in good.collect()} == {"l1": "a\nB b c\nd\nE", "l2": "a", "l3": "a", "l4": "a"}
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan



def test_board_in_parts(spark):
    """A part's items come after those of the parts before it; one bad part makes the board malformed."""
    part = lambda token, place, body: {"ats": "GREENHOUSE", "token": token, "place": place, "body": body}
    raw = raw_of(spark, part("a", 2, json.dumps({"jobs": [job(3)]})), part("a", 0, json.dumps({"jobs": [job(1), job(2, " ")]})), part("b", 0, json.dumps({"jobs": [job(4)]})), part("b", 1, "<html>"))
    good, boards = parse.snapshot(raw, ["GREENHOUSE"])
    assert sorted((r.board_token, r.external_id, r.pos) for r in good.collect()) == [("a", "1", 0), ("a", "3", 2)]
    assert sorted((r.board_token, r.ok, r.complete, r.n_skipped) for r in boards.collect()) == [("a", True, False, 1), ("b", False, False, 0)]


def test_paged_sources(spark):
    page = lambda total, *paths: json.dumps({"total": total, "jobPostings": [{"title": f"T{p}", "externalPath": p, "locationsText": "2 Locations"} for p in paths]})
    detail = json.dumps({"jobPostingInfo": {"title": "Real", "location": "Oslo", "startDate": "2026-02-03", "remoteType": "Flexible", "jobDescription": "<p>d</p>"}})
    smart = json.dumps({"totalFound": 1, "content": [{"id": "s1", "name": "Dev", "location": {"city": "Rome", "country": "it", "remote": False}, "function": {"label": "F"}, "releasedDate": "2026-01-01T00:00:00.000Z"}]})
    sections = json.dumps({"jobAd": {"sections": {"companyDescription": {"text": "c"}, "jobDescription": {"text": "<b>j</b>"}}}})
    t = "ten/wd1/site"
    raw = raw_of(
        spark, {"ats": "WORKDAY", "token": t, "kind": "page", "body": page(3, "/a", "/b")}, {"ats": "WORKDAY", "token": t, "kind": "page", "place": 20, "body": page(4, "/b", "/c")},
        {"ats": "WORKDAY", "token": t, "kind": "detail", "item": "/a", "body": detail}, {"ats": "SMARTRECRUITERS", "kind": "page", "body": smart}, {"ats": "SMARTRECRUITERS", "kind": "detail", "item": "s1", "body": sections},
    )
    good, boards = parse.snapshot(raw, ["WORKDAY", "SMARTRECRUITERS"])
    p = {r.external_id: r for r in good.collect()}
    assert set(p) == {f"{t}/a", f"{t}/b", f"{t}/c", "s1"}
    a = p[f"{t}/a"]
    assert (a.title, a.locations, a.workplace_type, a.url) == ("Real", ["Oslo"], "HYBRID", "https://ten.wd1.myworkdayjobs.com/site/a") and a.source_published_at.day == 3
    assert p[f"{t}/b"].locations == [] and p[f"{t}/b"].title == "T/b"
    assert (p["s1"].locations, p["s1"].workplace_type, p["s1"].description, p["s1"].url) == (["Rome, it"], "ONSITE", "j\nc", "https://jobs.smartrecruiters.com/acme/s1")
    b = {r.ats: r for r in boards.collect()}
    # Both reasons hold on the second page; the shift is the first of the two in the order that the rule gives them.
    assert (b["WORKDAY"].complete, b["WORKDAY"].reason) == (False, "listing shifted between pages")
    assert b["SMARTRECRUITERS"].complete


def test_ingest_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    boards = [config.Board("Acme", "GREENHOUSE", "acme")]
    body = lambda *jobs: raw_of(spark, {"ats": "GREENHOUSE", "body": json.dumps({"jobs": jobs})})
    first = ingest(store, body(job(1), job(2, "SWE"), job(2, "again")), boards, T0, profile=config.PROFILE)
    assert first.sync == {"created": 2, "updated": 0, "reopened": 0, "closed": 0} and first.postings_fetched == 3 and first.companies_succeeded == 1
    second = ingest(store, body(job(1, location=None, content="")), boards, T0 + timedelta(days=1), profile=config.PROFILE)
    assert second.sync == {"created": 0, "updated": 1, "reopened": 0, "closed": 1}
    incomplete = ingest(store, body(job(2), job(3, "")), boards, T0 + timedelta(days=2), profile=config.PROFILE)
    assert incomplete.sync == {"created": 0, "updated": 0, "reopened": 1, "closed": 0} and incomplete.incomplete_boards
    failed = ingest(store, raw_of(spark, {"ats": "GREENHOUSE", "error": "boom"}), boards, T0 + timedelta(days=3))
    assert failed.companies_succeeded == 0 and failed.failures and sum(failed.sync.values()) == 0
    rows = {r.external_id: r for r in store.postings().collect()}
    assert rows["1"].locations == ["Remote - US"] and rows["1"].description == "Java" and rows["1"].skills == ["Java"]
    assert [rows[k].id for k in "12"] == [1, 2] and rows["2"].closed_at is None
    assert store.postings(boards[0]).count() == 2 and store.postings(config.Board("B", "GREENHOUSE", "b")).count() == 0
    assert store.version() == 4 and [r.id for r in store.runs().orderBy("id").collect()] == [1, 2, 3, 4]
    assert all(0 < r.fetch_time_ms < r.wall_time_ms and 0 < r.persist_time_ms < r.wall_time_ms for r in store.runs().collect())
    assert first.fetch_ms + first.persist_ms <= first.wall_ms
    unlock = store.lock()
    with pytest.raises(AlreadyRunning):
        ingest(store, body(job(1)), boards, T0)
    unlock()
    # A dead run's lock is taken over once, and the run that lost it doesn't remove the new one.
    old = Store(spark, str(tmp_path / "store"), stale_seconds=-1)
    unlock_new = old.lock()
    unlock()
    with pytest.raises(AlreadyRunning):
        store.lock()
    unlock_new()
    # A run that fails between its audit row and its version leaves neither.
    staged = store.stage_version(store.postings())
    store._spark.createDataFrame([(5, T0, "VIRTUAL", *[0] * 10, "lost")], f"{schemas.INGEST_RUN}, batch string").write.parquet(str(tmp_path / "store" / "runs" / "run=5"))
    assert store.runs().count() == 4 and not store.has_batch("lost") and store.version() == 4
    told = []
    noisy = Store(spark, str(tmp_path / "store"), on_commit=told.append)
    assert noisy.commit(staged, (T0, "VIRTUAL", *[0] * 10), "kept") == 5 and told == [5]
    assert store.has_batch("kept") and not store.has_batch("lost") and store.runs().count() == 5
    view = stats.stats(store.postings(), store.runs(), config.SkillDictionary().frame(spark), T0 + timedelta(days=4))
    assert view["open_postings"] + view["open_duplicates"] == 2 and view["crawl"]["runs"] == 5


def test_history_equals_iteration(spark):
    rng = random.Random(7)
    crawls = [("b", c, rng.random() < 0.6) for c in range(12)]
    seen = [("b", p, c) for p in range(60) for c in range(12) if rng.random() < 0.3]
    got = {r.posting: r for r in lifecycle.history(spark.createDataFrame(seen, "board string, posting long, crawl long"), spark.createDataFrame(crawls, "board string, crawl long, complete boolean")).collect()}
    for p in {x[1] for x in seen}:
        first = last = closed = None
        n = [0, 0, 0]
        for _, c, complete in crawls:
            if ("b", p, c) in seen:
                n[0] += first is not None and closed is None
                n[1] += closed is not None
                first, last, closed = first if first is not None else c, c, None
            elif complete and first is not None and closed is None:
                closed = c
                n[2] += 1
        r = got[p]
        assert (r.first_seen, r.last_seen, r.closed_at, r.n_updated, r.n_reopened, r.n_closed) == (first, last, closed, *n)


def _brute_links(rows, threshold):
    """Leader clustering over (id, company, title words, place, department, url), one after the other."""
    links, owner, leaders = {}, {}, {}
    for r in sorted(rows):
        i, company, words, place, dep, url = r
        if url in owner:
            links[i] = owner[url]
            continue
        owner[url] = i
        best = (0.0, None)
        for l in leaders.setdefault(company, []):
            u = set(words) | set(l[2])
            s = len(set(words) & set(l[2])) / len(u) if u else 1.0
            if s > best[0] and s >= threshold and place == l[3] and (dep is None or l[4] is None or dep == l[4]):
                best = (s, l[0])
        if best[1] is None:
            leaders[company].append(r)
        else:
            links[i] = best[1]
    return {i: links.get(to, to) for i, to in links.items()}


@pytest.mark.parametrize("threshold", [1.0, 0.5])
def test_links_equal_brute_force(spark, threshold):
    rng = random.Random(3)
    vocabulary = ["java", "cloud", "data", "web", "risk"]
    rows = [(i, f"c{rng.randrange(4)}", tuple(rng.sample(vocabulary, rng.randrange(0, 4))), rng.choice(["Oslo", "Rome"]), rng.choice([None, "A", "B"]), f"u{rng.randrange(250)}") for i in range(300)]
    df = spark.createDataFrame([(i, "LEVER", str(i), c, " ".join(w), [p], d, u) for i, c, w, p, d, u in rows], "id long, ats string, external_id string, company string, title string, locations array<string>, department string, canonical_url string")
    got = {r.duplicate_id: r.canonical_id for r in dedup.dedupe(df, threshold).collect()}
    assert got == _brute_links(rows, threshold)
    assert dedup.dedupe(df.limit(0), threshold).count() == 0


def test_export(spark, tmp_path, small):
    from postingworks.plans.views import postings

    state = postings(spark, small).cache()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "part-0.txt").write_text("of an earlier export\n")
    n = export.write_ndjson(state, str(tmp_path / "lines"), 0.5)
    parts = sorted((tmp_path / "lines").glob("part-*"))
    lines = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    ids = [x["posting"]["id"] for x in lines]
    assert ids == sorted(ids) and [p.name for p in tmp_path.iterdir()] == ["lines"]
    assert n == len(lines) > 0 and all(x["posting"]["closedAt"] is None and "compensation" in x for x in lines)
    for _ in range(2):  # the second one takes the place of the first
        export.write_array(state, str(tmp_path / "array"), 0.5)
    whole = (tmp_path / "array").read_text()
    assert whole.startswith("[\n") and whole.endswith("\n]\n")
    assert [x["posting"]["id"] for x in json.loads(whole)] == sorted(x["posting"]["id"] for x in lines)
    assert export.write_array(state.limit(0), str(tmp_path / "none")) == 0
    assert (tmp_path / "none").read_text() == "[\n]\n"
    # A move that fails brings the earlier export back.
    with pytest.raises(OSError):
        export._rename(spark, str(tmp_path / "missing"), str(tmp_path / "lines"))
    assert sorted((tmp_path / "lines").glob("part-*")) == parts


def test_filters():
    for bad in (dict(min_score=2.0), dict(min_score=float("nan")), dict(status="x")):
        with pytest.raises(ValueError):
            query.Filter(**bad)
    assert query.parse_since("2026-01-02") == datetime(2026, 1, 2, tzinfo=timezone.utc) and query.parse_since(" ") is None
    for bad in ("x", "2026-01-01T00:00:00"):
        with pytest.raises(ValueError):
            query.parse_since(bad)
    with pytest.raises(ValueError):
        stats.check_top(101)
    cache = stats.StatsCache()
    assert [cache.get(v, 5, lambda: v) for v in (1, 1, 2)] == [1, 1, 2]
    cache.drop(2)
    assert cache.get(2, 5, lambda: "again") == "again"


def test_pairs_csv(spark, tmp_path):
    row = {c: "x" for c in schemas.PAIRS} | {"weight": "2.5000", "title_similarity": "1.0000", "a_key": "LEVER:a:1", "b_key": "ASHBY:b", "a_locations": "A | B", "b_locations": "", "a_title": 'say "hi",\nyou', "label": "dup", "b_department": ""}
    quote = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set(',"\n') else v
    (tmp_path / "in.csv").write_text(",".join(schemas.PAIRS) + "\n" + ",".join(quote(row[c]) for c in schemas.PAIRS) + "\n")
    got = pairs.read_pairs(spark, str(tmp_path / "in.csv"))
    r = got.first()
    assert (r.a_external_id, r.a_locations, r.b_locations, r.duplicate, r.a_title, r.b_department) == ("a:1", ["A", "B"], [], True, 'say "hi",\nyou', None)
    pairs.write_pairs(got, str(tmp_path / "out"))
    again = pairs.read_pairs(spark, str(tmp_path / "out")).first()
    assert again == r


def test_wilson(spark):
    low, high = evaluate.wilson(F.lit(47), F.lit(50))
    r = spark.range(1).select(low, high, *evaluate.wilson(F.lit(0), F.lit(0))).first()
    assert (round(r[0], 3), round(r[1], 3)) == (0.838, 0.979) and r[2] != r[2]


def test_http():
    slept, calls = [], []
    settings = config.Settings()

    def failing(*errors):
        left = list(errors)

        def action():
            calls.append(1)
            if left:
                raise left.pop(0)
            return b"ok"

        return action

    retry = http.Retry(settings, slept.append, lambda top: top)
    assert retry.run(failing(http.UpstreamError("x", 500), http.UpstreamError("x"), http.UpstreamError("x", 429, 7))) == b"ok"
    assert slept == [0.5, 1.0, 7]
    for e in (http.NotFound("x", 404), http.UpstreamError("x", 503, 61)):
        with pytest.raises(http.UpstreamError):
            retry.run(failing(e))
    now = [0.0]
    bucket = http.TokenBucket(2, 2, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [bucket.acquire() for _ in range(4)] == [0, 0, 0.5, 0.5]


def test_reader():
    pages = {0: {"total": 45, "jobPostings": [{"externalPath": f"/{i}"} for i in range(20)]}, 20: {"total": 0, "jobPostings": [{"externalPath": f"/{i}"} for i in range(20, 40)]}, 40: {"total": 0, "jobPostings": [{"externalPath": "/40"}]}}

    class Fake:
        def fetch(self, url, body=None):
            if body:
                return json.dumps(pages[json.loads(body)["offset"]])
            if url.endswith("/1"):
                raise http.NotFound("gone", 404)
            return "{}"

    rows = reader.read_board(config.Board("W", "WORKDAY", "t/wd1/s"), 0, Fake(), reader.BASES, 3)
    assert [r[4] for r in rows] == ["page"] * 3 + ["detail"] * 3 and [r[7] for r in rows[3:]] == ["{}", None, "{}"]
    assert "ValueError" in reader.read_board(config.Board("W", "WORKDAY", "bad"), 0, Fake(), reader.BASES, 3)[0][8]


def test_stream(spark, tmp_path):
    from postingworks.streaming.lifecycle_stream import raw_stream, start_ingest

    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    line = {"ats": "GREENHOUSE", "company": "Acme", "board_token": "acme", "cfg_pos": 0, "kind": "board", "place": 0, "body": json.dumps({"jobs": [job(1)]})}
    (tmp_path / "in" / "a.json").write_text(json.dumps(line))
    q = start_ingest(raw_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), lambda: T0, lambda batch: [config.Board("Acme", "GREENHOUSE", "acme")])
    q.processAllAvailable()
    q.stop()
    assert store.postings().count() == 1
    assert store.has_batch(f"{tmp_path / 'cp'}#0")
    # Another stream on the same store, whose first batch is number 0 again, is not taken for a repeat of the first one.
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "b.json").write_text(json.dumps(line | {"board_token": "other", "body": json.dumps({"jobs": [job(2)]})}))
    for _ in range(2):  # the second time the checkpoint has nothing new
        q = start_ingest(raw_stream(spark, str(tmp_path / "in2")), store, str(tmp_path / "cp2"), lambda: T0, lambda batch: [config.Board("Acme", "GREENHOUSE", "other")])
        q.processAllAvailable()
        q.stop()
    assert sorted(r.external_id for r in store.postings().collect()) == ["1", "2"] and store.version() == 2
    # A batch that was committed, but not yet noted by the stream, is skipped.
    (tmp_path / "in3").mkdir()
    (tmp_path / "in3" / "c.json").write_text(json.dumps(line | {"body": json.dumps({"jobs": [job(3)]})}))
    store.commit(store.stage_version(store.postings()), (T0, "VIRTUAL", *[0] * 10), f"{tmp_path / 'cp3'}#0")
    q = start_ingest(raw_stream(spark, str(tmp_path / "in3")), store, str(tmp_path / "cp3"), lambda: T0, lambda batch: [config.Board("Acme", "GREENHOUSE", "acme")])
    q.processAllAvailable()
    q.stop()
    assert store.version() == 3 and store.postings().count() == 2


def test_paging_stops_at_the_guard(monkeypatch):
    monkeypatch.setattr(reader, "PAGE_GUARD", 60)

    class Endless:
        def fetch(self, url, body=None):
            return json.dumps({"total": None, "jobPostings": [{"externalPath": f"/{json.loads(body)['offset'] + i}"} for i in range(20)]}) if body else "{}"

    rows = reader.read_board(config.Board("W", "WORKDAY", "t/wd1/s"), 0, Endless(), reader.BASES, 2)
    assert [r[5] for r in rows if r[4] == "page"] == [0, 20, 40] and sum(r[4] == "detail" for r in rows) == 2


def test_guard_makes_a_board_incomplete(spark, monkeypatch):
    monkeypatch.setattr(parse, "PAGE_GUARD", 40)
    page = lambda at: json.dumps({"total": 100, "jobPostings": [{"title": "T", "externalPath": f"/{i}"} for i in range(at, at + 20)]})
    raw = raw_of(spark, *[{"ats": "WORKDAY", "token": "t/wd1/s", "kind": "page", "place": at, "body": page(at)} for at in (0, 20)])
    b = parse.snapshot(raw, ["WORKDAY"])[1].first()
    assert (b.ok, b.complete, b.reason) == (True, False, "stopped paging at 40 postings")


@pytest.mark.parametrize("mode, pool, n", [("SEQUENTIAL", 16, 1), ("PLATFORM_POOL", 2, 2), ("PLATFORM_POOL", 16, 3), ("VIRTUAL", 16, 3)])
def test_partitions_of_modes(mode, pool, n):
    boards = [{"name": "", "ats": a, "token": t} for a, t in [("LEVER", "a"), ("LEVER", "b"), ("ASHBY", "a"), ("WORKDAY", "t/wd1/s"), ("WORKDAY", "t/wd1/r")]]
    parts = reader._Reader({"boards": json.dumps(boards), "mode": mode, "settings": json.dumps({"pool_size": pool})}).partitions()
    hosts = [{b["token"].split("/")[0] if b["ats"] == "WORKDAY" else b["ats"] for _, b in p.boards} for p in parts]
    # Boards of one host are never in two partitions.
    assert len(parts) == n and sum(map(len, hosts)) == len(set().union(*hosts)) == 3


def test_unknown_sources():
    with pytest.raises(ValueError):
        parse.parser_for("MONSTER")
    assert set(parse.PARSERS) == set(config.ATS_ORDER)


def test_boards_and_profile_of_files(tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"name": "A", "ats": "LEVER", "token": "a"}, {"ats": "ASHBY", "token": "b"}]))
    boards = config.load_boards(str(tmp_path / "b.json"))
    assert [(b.name, b.ats, b.token) for b in boards] == [("A", "LEVER", "a"), ("b", "ASHBY", "b")]
    assert config.resolve_boards(None, boards) == boards and config.resolve_boards(["ashby:B", "a"], boards) == boards[::-1]
    with pytest.raises(ValueError):
        config.resolve_boards(["zzz"], boards)


def test_no_window_over_whole_tables(spark, small):
    """Windows have keys of bounded groups, or rows of bounded number: boards, days, ranges of ids."""
    from postingworks.operators import sampling
    from postingworks.plans.views import postings

    state = postings(spark, small)
    plan = sampling.stratified_sample(sampling.company_pairs(dedup.open_candidates(state)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    r = stats.exact_percentiles(spark.createDataFrame([(x,) for x in (4 * 86400, 17 * 86400, None)], "s long"), [0.5, 0.75]).first()
    assert (r.n, r.p0 / 86400, r.p1 / 86400) == (2, 10.5, 13.75)
    r = stats.exact_percentiles(spark.createDataFrame([], "s long"), [0.5]).first()
    assert (r.n, r.p0) == (0, None)


def test_command_line(spark, tmp_path, capsys):
    from postingworks import __main__ as cli

    store = Store(spark, str(tmp_path / "store"))
    boards = [config.Board("Acme", "GREENHOUSE", "acme")]
    raw = raw_of(spark, {"ats": "GREENHOUSE", "body": json.dumps({"jobs": [job(1), job(2, "SWE")]})}, {"ats": "GREENHOUSE", "kind": "retries", "place": 3})
    report = ingest(store, raw, boards, T0, profile=config.PROFILE)
    assert report.retries == 3 and report.companies_succeeded == 1 and report.postings_fetched == 2
    export_to = lambda *more: cli.main(["export", "--store", str(tmp_path / "store"), "--out", str(tmp_path / "out"), "--array", *more], spark)
    assert export_to() == 0 and len(json.loads((tmp_path / "out").read_text())) == 2 and capsys.readouterr().out.strip() == "2"
    assert export_to("--min-score", "7") == 1 and export_to("--since", "soon") == 1
    (tmp_path / "b.json").write_text(json.dumps([{"ats": "LEVER", "token": "a"}]))
    crawl = ["crawl", "--store", str(tmp_path / "store"), "--boards", str(tmp_path / "b.json")]
    assert cli.main([*crawl, "--only", "zzz"], spark) == 1
    unlock = store.lock()
    assert cli.main(crawl, spark) == 1  # another run is in progress
    unlock()
    at = lambda h: datetime(2026, 1, 1, h, tzinfo=timezone.utc)
    assert cli.next_run(at(6), "07:00") == at(7) and cli.next_run(at(7), "07:00") == at(7) + timedelta(days=1)
    slept, codes = [], [1, 0]
    assert cli.every_day("07:00", lambda: codes.pop(0), lambda: at(6), slept.append, 2) == 0 and slept == [3600.0, 3600.0]


def test_retries_reach_the_driver():
    class Flaky:
        retries = 0

        def fetch(self, url, body=None):
            Flaky.retries += 2
            return "[]"

    rows = reader.read_board(config.Board("L", "LEVER", "a"), 0, Flaky(), reader.BASES, 3)
    assert [(r[4], r[5]) for r in rows] == [("board", 0), ("retries", 2)]


def test_open_url():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code = int(self.path[1:])
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(b"body")

        def do_POST(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.headers["Content-Type"].encode() + self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, settings = f"http://127.0.0.1:{server.server_port}", config.Settings()
    assert http.open_url(f"{base}/200", None, settings) == b"body" and http.open_url(f"{base}/200", "{}", settings) == b"application/json{}"
    with pytest.raises(http.NotFound):
        http.open_url(f"{base}/404", None, settings)
    with pytest.raises(http.UpstreamError) as e:
        http.open_url(f"{base}/429", None, settings)
    assert (e.value.status, e.value.retry_after_s, e.value.retryable) == (429, 7, True)
    server.shutdown()
    server.server_close()
    with pytest.raises(http.UpstreamError) as e:
        http.open_url(f"{base}/200", None, settings)
    assert e.value.status is None and e.value.retryable


def test_links_of_postings_without_a_url(spark):
    rows = [(1, "LEVER", "a", "Acme", "Dev", ["Oslo"], None, None), (2, "LEVER", "b", "Acme", "Dev", ["Oslo"], None, None), (3, "LEVER", "c", "Acme", "Dev", [], None, None)]
    df = spark.createDataFrame(rows, "id long, ats string, external_id string, company string, title string, locations array<string>, department string, canonical_url string")
    assert [(r.duplicate_id, r.canonical_id, r.reason) for r in dedup.dedupe(df).collect()] == [(2, 1, "FUZZY")]
    m = dedup.dedup_metrics(df).first()
    assert (m.candidates, m.exact_duplicates, m.fuzzy_duplicates, m.pairs_compared) == (3, 0, 1, 2)


def test_truncated_counts_utf16_units(spark):
    from postingworks.functions.text import truncated

    rows = spark.createDataFrame([("abcdef",), ("a😀😀",), ("😀😀😀",), ("ab",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(truncated(F.col("s"), 4)).collect()] == ["abcd", "a😀", "😀😀", "ab", "", None]
