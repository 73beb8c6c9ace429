"""Raw JSON bodies to postings, one parser per source, as plain column expressions.

Input: the RAW table of one crawl. Output of `snapshot`: postings (with board, position and a validity flag taken into
account) and one row per board with its completeness. A body that can't be read, or lacks its list, makes the board
malformed: it is not synchronised. An item that breaks the rules of a posting is skipped and makes its board incomplete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas
from ..config import ATS_ORDER
from ..functions import urls
from ..functions.html import to_text, to_texts
from ..functions.text import is_blank, strings, strip
from ..functions.values import instant, offset_time, pay_range, start_of_day, workplace, workplace_of_phrase

BOARD = ["ats", "company", "board_token", "cfg_pos"]
PAGE_GUARD = 10_000
PAGE_SIZE = {"WORKDAY": 20, "SMARTRECRUITERS": 100}


def _none() -> Column:
    return strings([])


def _lines(parts: Column) -> Column:
    """Non-blank parts, stripped, one per line."""
    return F.array_join(F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != ""), "\n")


def _finish(items: DataFrame, ats: str, **c: Column) -> DataFrame:
    """The posting columns in one order; description_html is turned to text in one place."""
    url = strip(c["url"])
    return items.select(
        *BOARD, "pos", c["external_id"].alias("external_id"), strip(c["title"]).alias("title"), F.coalesce(c["locations"], _none()).alias("locations"),
        c["workplace"].alias("workplace_type"), c["department"].alias("department"), url.alias("url"), urls.canonicalize(url).alias("canonical_url"),
        F.coalesce(c["description"], F.lit("")).alias("description"), c["published"].alias("source_published_at"), c["compensation"].alias("compensation"),
    )


def _board_items(raw: DataFrame, ats: str, schema: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Items of single-body boards, and whether each board's body had its list. A body may be recorded in several rows, each
    a body with a part of the list, from the position `place` on; one bad part makes the board malformed."""
    rows = raw.where((F.col("ats") == ats) & (F.col("kind") == "board") & F.col("error").isNull())
    parsed = rows.select(*BOARD, F.coalesce("place", F.lit(0)).alias("place"), F.from_json("body", schema).alias("b")).select(*BOARD, "place", F.col(path).alias("list"))
    items = parsed.select(*BOARD, "place", F.posexplode("list").alias("at", "x")).select(*BOARD, (F.col("place") + F.col("at")).alias("pos"), "x")
    return items, parsed.groupBy(*BOARD).agg(F.max(F.col("list").isNull()).alias("malformed")).withColumn("reason", F.lit(None).cast("string"))


def greenhouse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    items, boards = _board_items(raw, "GREENHOUSE", schemas.GREENHOUSE, "b.jobs")
    place = F.col("x.location.name")
    names = F.filter(F.transform(F.coalesce(F.col("x.departments"), F.array().cast("array<struct<name:string>>")), lambda d: d["name"]), lambda n: ~is_blank(n))
    return _finish(
        items, "GREENHOUSE", external_id=F.col("x.id").cast("string"), title=F.col("x.title"), locations=F.when(is_blank(place), _none()).otherwise(F.array(strip(place))),
        workplace=F.when(F.lower(place).contains("remote"), "REMOTE").otherwise("UNKNOWN"), department=F.get(names, F.lit(0)), url=F.col("x.absolute_url"),
        description=to_text(F.col("x.content")), published=offset_time(F.coalesce("x.first_published", "x.updated_at")), compensation=F.lit(None).cast("string"),
    ), boards


def lever(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    items, boards = _board_items(raw, "LEVER", schemas.LEVER, "b")
    # Sections hold HTML; those of an item stay in its row, so that no items are shuffled to meet their sections.
    sections = F.zip_with("x.lists", to_texts(F.transform("x.lists", lambda s: s["content"])), lambda s, text: F.concat(F.coalesce(s["text"], F.lit("")), F.lit(" "), text))
    c = F.col("x.categories")
    many = F.size(F.coalesce(c["allLocations"], _none())) > 0
    lines = F.concat(F.array(F.coalesce("x.descriptionPlain", F.lit(""))), F.coalesce(sections, _none()), F.array(F.coalesce("x.additionalPlain", F.lit(""))))
    pay = F.col("x.salaryRange")
    return _finish(
        items, "LEVER", external_id=F.col("x.id"), title=F.col("x.text"), locations=F.when(many, c["allLocations"]).when(c["location"].isNotNull(), F.array(c["location"])),
        workplace=workplace(F.col("x.workplaceType")), department=F.coalesce(c["department"], c["team"]), url=F.col("x.hostedUrl"), description=_lines(lines),
        published=F.timestamp_millis("x.createdAt"), compensation=pay_range(pay["currency"], pay["min"], pay["max"], pay["interval"]),
    ), boards


def ashby(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    items, boards = _board_items(raw, "ASHBY", schemas.ASHBY, "b.jobs")
    items = items.where(~F.coalesce(F.col("x.isListed") == F.lit(False), F.lit(False)))  # unlisted ones are no part of the market
    others = F.transform(F.coalesce(F.col("x.secondaryLocations"), F.array().cast("array<struct<location:string>>")), lambda s: s["location"])
    kind = workplace(F.col("x.workplaceType"))
    return _finish(
        items, "ASHBY", external_id=F.col("x.id"), title=F.col("x.title"), locations=F.filter(F.concat(F.array("x.location"), others), lambda s: ~is_blank(s)),
        workplace=F.when((kind == "UNKNOWN") & F.coalesce("x.isRemote", F.lit(False)), "REMOTE").otherwise(kind), department=F.coalesce("x.department", "x.team"), url=F.col("x.jobUrl"),
        description=F.when(~is_blank(F.col("x.descriptionPlain")), strip(F.col("x.descriptionPlain"))).otherwise(to_text(F.col("x.descriptionHtml"))),
        published=offset_time(F.col("x.publishedAt")), compensation=F.col("x.compensation.compensationTierSummary"),
    ), boards


def _paged(raw: DataFrame, ats: str, page: str, total: str, items_at: str, ident: str, detail: str, max_details: int) -> tuple[DataFrame, DataFrame]:
    """Items of paged boards, first occurrence of each id, with the details of the first max_details; and the boards'
    verdicts: drift between pages and the page guard make a board incomplete, the first reason counts."""
    pages = raw.where((F.col("ats") == ats) & (F.col("kind") == "page") & F.col("error").isNull()).select(*BOARD, "place", F.from_json("body", page).alias("p"))
    pages = pages.select(*BOARD, "place", F.col(f"p.{total}").alias("total"), F.col(f"p.{items_at}").alias("list"))
    each = pages.select(*BOARD, "place", F.posexplode("list").alias("at", "x")).withColumn("item", F.coalesce(F.col(f"x.{ident}"), F.lit("null")))
    nth = F.row_number().over(Window.partitionBy("ats", "board_token", "item").orderBy("place", "at"))
    numbered = each.withColumn("nth", nth)
    unique = numbered.where("nth = 1").withColumn("pos", F.row_number().over(Window.partitionBy("ats", "board_token").orderBy("place", "at")) - 1)
    details = raw.where((F.col("ats") == ats) & (F.col("kind") == "detail") & F.col("error").isNull() & F.col("body").isNotNull()).select("ats", "board_token", "item", F.from_json("body", detail).alias("d"))
    items = unique.join(details, ["ats", "board_token", "item"], "left").withColumn("d", F.when(F.col("pos") < max_details, F.col("d")))
    first_total = F.first_value("total").over(Window.partitionBy("ats", "board_token").orderBy("place"))
    repeats = numbered.where("nth > 1").groupBy(*BOARD).agg(F.min(F.struct("place", F.lit("listing shifted between pages").alias("reason"))).alias("shift"))
    checked = pages.withColumn("first_total", first_total).groupBy(*BOARD).agg(
        F.max(F.col("list").isNull()).alias("malformed"),
        F.min(F.when((F.col("total") != 0) & (F.col("total") != F.col("first_total")), F.struct("place", F.concat(F.lit("total changed: "), F.col("first_total").cast("string"), F.lit(" -> "), F.col("total").cast("string")).alias("reason")))).alias("drift"),
        F.sum(F.size("list")).alias("fetched"), F.max_by(F.size("list"), "place").alias("last_size"), F.max("place").alias("end"), F.first("first_total").alias("announced"),
    )
    # The reader stops at the guard: the last page is full and more were announced (no total means no bound).
    cut = (F.col("fetched") >= PAGE_GUARD) & (F.col("last_size") >= PAGE_SIZE[ats]) & (F.col("fetched") < F.coalesce("announced", F.lit(1 << 31)))
    checked = checked.withColumn("guard", F.when(cut, F.struct((F.col("end") + 1).alias("place"), F.concat(F.lit("stopped paging at "), F.lit(PAGE_GUARD), F.lit(" postings")).alias("reason"))))
    boards = checked.join(repeats, BOARD, "left").select(*BOARD, "malformed", F.array_min(F.filter(F.array("shift", "drift", "guard"), lambda s: s.isNotNull()))["reason"].alias("reason"))
    return items, boards


def workday(raw: DataFrame, max_details: int = 50, base: str = "https://{tenant}.{wd}.myworkdayjobs.com") -> tuple[DataFrame, DataFrame]:
    items, boards = _paged(raw, "WORKDAY", schemas.WORKDAY_PAGE, "total", "jobPostings", "externalPath", schemas.WORKDAY_DETAIL, max_details)
    part = F.split("board_token", "/")
    origin = F.replace(F.replace(F.lit(base.rstrip("/")), F.lit("{tenant}"), F.get(part, F.lit(0))), F.lit("{wd}"), F.get(part, F.lit(1)))
    info, text, path = F.col("d.jobPostingInfo"), F.col("x.locationsText"), F.col("x.externalPath")
    places = F.when(info["location"].isNotNull(), F.concat(F.array(info["location"]), F.coalesce(info["additionalLocations"], _none()))).when(text.isNotNull() & ~text.rlike(r"^\d+ Locations?$"), F.array(text))
    return _finish(
        items, "WORKDAY", external_id=F.concat("board_token", path), title=F.coalesce(info["title"], F.col("x.title")), locations=places, workplace=workplace_of_phrase(info["remoteType"]),
        department=F.lit(None).cast("string"), url=F.coalesce(info["externalUrl"], F.concat(origin, F.lit("/"), F.get(part, F.lit(2)), path)), description=to_text(info["jobDescription"]),
        published=start_of_day(info["startDate"]), compensation=F.lit(None).cast("string"),
    ), boards


def workday_token(token: str) -> tuple[str, str, str]:
    """tenant, data centre and site of a Workday board token."""
    parts = token.split("/")
    if len(parts) != 3 or not (parts[1].startswith("wd") and parts[1][2:].isdigit()):
        raise ValueError(f"a Workday board token is tenant/wdN/site, not {token}")
    return parts[0], parts[1], parts[2]


def smartrecruiters(raw: DataFrame, max_details: int = 50, public: str = "https://jobs.smartrecruiters.com/") -> tuple[DataFrame, DataFrame]:
    items, boards = _paged(raw, "SMARTRECRUITERS", schemas.SMART_PAGE, "totalFound", "content", "id", schemas.SMART_DETAIL, max_details)
    at = F.col("x.location")
    blank = F.lit("")
    text = F.coalesce(at["fullLocation"], F.concat_ws(",", F.coalesce(at["city"], blank), F.coalesce(at["region"], blank), F.coalesce(at["country"], blank)))
    clean = F.array_join(F.filter(F.transform(F.split(text, ","), strip), lambda s: s != ""), ", ")
    s = F.col("d.jobAd.sections")
    # One text at a time through the HTML function; the order of sections is that of the result.
    lines = F.array(*[to_text(s[k]["text"]) for k in ("jobDescription", "qualifications", "additionalInformation", "companyDescription")])
    kind = F.when(at["remote"], "REMOTE").when(at["hybrid"], "HYBRID").when(at["remote"].isNotNull(), "ONSITE").otherwise("UNKNOWN")
    return _finish(
        items, "SMARTRECRUITERS", external_id=F.col("x.id"), title=F.col("x.name"), locations=F.when(at.isNotNull() & (clean != ""), F.array(clean)), workplace=kind,
        department=F.coalesce("x.department.label", "x.function.label"), url=F.coalesce(F.col("d.postingUrl"), F.concat(F.lit(public), F.col("board_token"), F.lit("/"), F.coalesce("x.id", F.lit("null")))),
        description=_lines(lines), published=instant(F.col("x.releasedDate")), compensation=F.lit(None).cast("string"),
    ), boards


PARSERS = dict(zip(ATS_ORDER, (greenhouse, lever, ashby, workday, smartrecruiters)))


def parser_for(ats: str):
    if ats not in PARSERS:
        raise ValueError(f"no source for {ats}")
    return PARSERS[ats]


def snapshot(raw: DataFrame, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, boards): valid postings in listing order, and per board ok, complete, reason, n_skipped."""
    parts = [parser_for(a)(raw) for a in (sources or ATS_ORDER)]
    postings = reduce(DataFrame.unionByName, [p for p, _ in parts])
    verdicts = reduce(DataFrame.unionByName, [b for _, b in parts])
    valid = ~is_blank(F.col("external_id")) & ~is_blank(F.col("company")) & ~is_blank(F.col("title")) & ~is_blank(F.col("url"))
    postings = postings.withColumn("valid", valid)
    skipped = postings.groupBy(*BOARD).agg(F.count_if(~F.col("valid")).alias("n_skipped"))
    failed = raw.where("error is not null").groupBy(*BOARD).agg(F.min("error").alias("error"))
    known = raw.select(*BOARD).distinct().join(verdicts, BOARD, "left").join(failed, BOARD, "left")
    boards = known.join(skipped, BOARD, "left")
    n = F.coalesce("n_skipped", F.lit(0))
    ok = F.col("error").isNull() & ~F.coalesce("malformed", F.lit(True))
    reason = F.when(n > 0, F.concat(n.cast("string"), F.lit(" postings could not be parsed"))).otherwise(F.col("reason"))
    boards = boards.select(*BOARD, ok.alias("ok"), (ok & reason.isNull()).alias("complete"), reason.alias("reason"), F.coalesce("error", F.when(F.coalesce("malformed", F.lit(True)), F.lit("malformed body"))).alias("error"), n.alias("n_skipped"))
    good = postings.where("valid").drop("valid").join(known.where(ok).select("ats", "board_token"), ["ats", "board_token"], "left_semi")
    return good, boards
