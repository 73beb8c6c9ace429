"""Queries over recordings: bodies of every source are made from the driver's tables, then parsed again, and the SQL says
what the parsers make of the rows they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import config
from ..functions.html import to_text
from ..functions.values import start_of_day
from ..operators import lifecycle, stats
from ..sources import parse
from .views import POSTING_SQL, part_of, pick, postings, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _raw(rows: DataFrame, ats: str, token, kind: str, place, item, body) -> DataFrame:
    """RAW rows of one board a nation; rows have n_name and n_nationkey."""
    none = F.lit(None).cast("string")
    return rows.select(F.lit(ats).alias("ats"), F.col("n_name").alias("company"), token.alias("board_token"), F.col("n_nationkey").cast("int").alias("cfg_pos"), F.lit(kind).alias("kind"), place.cast("long").alias("place"), item.alias("item"), body.alias("body"), none.alias("error"))


def _with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    return postings(spark, sf_dir).join(nation, F.col("board_token") == F.col("n_name"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with their nation and idx, their place on its board, from 0."""
    return _with_nation(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("board_token").orderBy("id")) - 1)


def _board(spark: SparkSession, sf_dir: str, ats: str, item, wrap=None) -> DataFrame:
    """The bodies of each board, one a part: its items in the order of their ids."""
    jobs = _with_nation(spark, sf_dir).groupBy("n_name", "n_nationkey", part_of("id").alias("place")).agg(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).alias("xs"))
    items = F.transform("xs", lambda x: x["x"])
    body = F.to_json(items if wrap is None else F.struct(items.alias(wrap)))
    return _raw(jobs, ats, F.col("n_name"), "board", F.col("place"), F.lit(None).cast("string"), body)


def _paged(rows: DataFrame, ats: str, token, size: int, total: str, wrap: str, item, ident, detail) -> DataFrame:
    """Pages of `size` items and a detail for each item. On the pages after the first, NATION_3 announces one item more,
    and NATION_5 lists its first item once again."""
    first = F.first_value(item).over(Window.partitionBy("n_name").orderBy("id"))
    known = rows.withColumn("n", F.count("*").over(Window.partitionBy("n_name"))).withColumn("again", first).withColumn("place", F.floor(F.col("idx") / size) * size)
    pages = known.groupBy("n_name", "n_nationkey", "place").agg(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).alias("xs"), F.first("n").alias("n"), F.first("again").alias("again"))
    late = F.col("place") > 0
    items = F.when(late & (F.col("n_name") == "NATION_5"), F.concat(F.transform("xs", lambda x: x["x"]), F.array("again"))).otherwise(F.transform("xs", lambda x: x["x"]))
    announced = F.col("n") + F.when(late & (F.col("n_name") == "NATION_3"), 1).otherwise(0)
    listed = _raw(pages, ats, token, "page", F.col("place"), F.lit(None).cast("string"), F.to_json(F.struct(announced.alias(total), items.alias(wrap))))
    return listed.union(_raw(rows, ats, token, "detail", F.col("idx"), ident, F.to_json(detail)))


def _fields(good: DataFrame) -> DataFrame:
    """Parsed postings in the form that both engines print."""
    return good.select("board_token", "external_id", "title", F.array_join("locations", "|").alias("locations"), "workplace_type", "department", "url", "canonical_url", "description", F.unix_seconds("source_published_at").cast("string").alias("published"), "compensation")


def _sql(body: str, more: str = "") -> str:
    return f"WITH {POSTING_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY board_token ORDER BY id) - 1 AS idx FROM posting){more} {body}"


# Single bodies

_LEVER_KINDS = ["On-site", "hybrid", "remote", "elsewhere"]


@_query(_sql("""SELECT board_token, 'i' || id AS external_id, title, array_to_string(CASE WHEN id % 2 = 0 THEN locations ELSE locations[1:1] END, '|') AS locations,
  ['ONSITE', 'HYBRID', 'REMOTE', 'UNKNOWN'][(id % 4 + 1)::INTEGER] AS workplace_type, coalesce(department, 'Team') AS department, url, canonical_url,
  description || CASE WHEN id % 3 = 0 THEN chr(10) || 'Need a & b' || chr(10) || 'more' ELSE '' END AS description, first_seen::VARCHAR AS published,
  CASE WHEN id % 2 = 0 THEN 'USD ' || format('{:,}', id % 5000 + 1) || '–' || format('{:,}', id % 5000 + 2001) || CASE WHEN id % 4 = 0 THEN ' per-year' ELSE '' END END AS compensation FROM w"""))
def lever_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    pay = F.when(key % 2 == 0, F.struct(F.lit("USD").alias("currency"), F.when(key % 4 == 0, "per-year").alias("interval"), (key % 5000 + 0.5).alias("min"), (key % 5000 + 2000.5).alias("max")))
    section = F.array(F.struct(F.lit("Need").alias("text"), F.lit("<li>a &amp;amp; </li><li>b</li>").alias("content")))
    item = F.struct(
        F.concat(F.lit("i"), key.cast("string")).alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), (F.unix_seconds("first_seen_at") * 1000).alias("createdAt"),
        F.struct("department", F.get("locations", F.lit(0)).alias("location"), F.lit("Team").alias("team"), F.when(key % 2 == 0, F.col("locations")).alias("allLocations")).alias("categories"),
        pick(_LEVER_KINDS, key % 4).alias("workplaceType"), F.concat(F.lit(" "), F.col("description"), F.lit("\n")).alias("descriptionPlain"), F.when(key % 3 == 0, section).alias("lists"),
        F.when(key % 3 == 0, " more ").otherwise(" ").alias("additionalPlain"), pay.alias("salaryRange"),
    )
    return _fields(parse.snapshot(_board(spark, sf_dir, "LEVER", item), ["LEVER"])[0])


@_query(_sql("""SELECT board_token, 'a' || id AS external_id, title, array_to_string([locations[1], 'Rome'], '|') AS locations,
  CASE WHEN id % 3 = 0 THEN 'HYBRID' WHEN id % 2 = 0 THEN 'REMOTE' ELSE 'UNKNOWN' END AS workplace_type, coalesce(department, 'Team') AS department, url, canonical_url, description,
  (first_seen - 3600)::VARCHAR AS published, CASE WHEN id % 2 = 0 THEN 'tier ' || id END AS compensation FROM w WHERE id % 5 <> 0"""))
def ashby_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    places = F.array(F.struct(F.lit(" ").alias("location")), F.struct(F.lit("Rome").alias("location")))
    item = F.struct(
        F.concat(F.lit("a"), key.cast("string")).alias("id"), "title", "department", F.lit("Team").alias("team"), F.get("locations", F.lit(0)).alias("location"), places.alias("secondaryLocations"),
        (key % 2 == 0).alias("isRemote"), F.when(key % 3 == 0, "Hybrid").alias("workplaceType"), F.date_format("first_seen_at", "yyyy-MM-dd'T'HH:mm:ss'+01:00'").alias("publishedAt"),
        F.when(key % 5 == 0, False).when(key % 5 == 1, True).alias("isListed"), F.col("url").alias("jobUrl"), F.when(key % 2 == 0, F.concat(F.lit(" "), "description")).otherwise(" ").alias("descriptionPlain"),
        F.concat(F.lit("<div><p>"), "description", F.lit("</p></div>")).alias("descriptionHtml"), F.struct(F.when(key % 2 == 0, F.concat(F.lit("tier "), key.cast("string"))).alias("compensationTierSummary")).alias("compensation"),
    )
    return _fields(parse.snapshot(_board(spark, sf_dir, "ASHBY", item, "jobs"), ["ASHBY"])[0])


# Pages and details


def _workday(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = _listed(spark, sf_dir), F.col("id")
    path, place = F.concat(F.lit("/job/"), key.cast("string")), F.get("locations", F.lit(0))
    item = F.struct("title", path.alias("externalPath"), F.when(key % 2 == 0, "2 Locations").otherwise(place).alias("locationsText"))
    info = F.struct(
        F.concat(F.lit("Full "), "title").alias("title"), F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("jobDescription"), F.when(key % 3 != 0, place).alias("location"),
        F.when(key % 2 == 0, F.array(F.lit("Rome"))).alias("additionalLocations"), F.date_format("first_seen_at", "yyyy-MM-dd").alias("startDate"), pick(["Flexible", "On site", "Fully remote", "?"], key % 4).alias("remoteType"),
        F.when(key % 2 == 0, F.col("url")).alias("externalUrl"),
    )
    return _paged(rows, "WORKDAY", F.concat("n_name", F.lit("/wd1/site")), 20, "total", "jobPostings", item, path, F.struct(info.alias("jobPostingInfo")))


_WORKDAY_URL = "'https://' || board_token || '.wd1.myworkdayjobs.com/site/job/' || id"


@_query(_sql(f"""SELECT board_token || '/wd1/site' AS board_token, board_token || '/wd1/site/job/' || id AS external_id, CASE WHEN idx < 50 THEN 'Full ' ELSE '' END || title AS title,
  CASE WHEN idx < 50 AND id % 3 <> 0 THEN array_to_string(CASE WHEN id % 2 = 0 THEN [locations[1], 'Rome'] ELSE locations[1:1] END, '|') WHEN id % 2 = 0 THEN '' ELSE locations[1] END AS locations,
  CASE WHEN idx >= 50 THEN 'UNKNOWN' ELSE ['HYBRID', 'ONSITE', 'REMOTE', 'UNKNOWN'][(id % 4 + 1)::INTEGER] END AS workplace_type,
  CASE WHEN idx < 50 AND id % 2 = 0 THEN url ELSE {_WORKDAY_URL} END AS url, CASE WHEN idx < 50 AND id % 2 = 0 THEN canonical_url ELSE lower({_WORKDAY_URL}) END AS canonical_url,
  CASE WHEN idx < 50 THEN description ELSE '' END AS description, CASE WHEN idx < 50 THEN (first_seen // 86400 * 86400)::VARCHAR END AS published FROM w"""))
def workday_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(parse.snapshot(_workday(spark, sf_dir), ["WORKDAY"])[0]).drop("department", "compensation")


@_query(_sql("""SELECT board_token || '/wd1/site' AS board_token, true AS ok, NOT late AS complete,
  CASE WHEN late AND board_token = 'NATION_3' THEN 'total changed: ' || n || ' -> ' || (n + 1) WHEN late THEN 'listing shifted between pages' END AS reason
  FROM (SELECT board_token, count(*) AS n, count(*) > 20 AND board_token IN ('NATION_3', 'NATION_5') AS late FROM w GROUP BY 1)"""))
def paged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.snapshot(_workday(spark, sf_dir), ["WORKDAY"])[1].select("board_token", "ok", "complete", "reason")


@_query(_sql("""SELECT board_token, 's' || id AS external_id, title, CASE WHEN id % 4 = 0 THEN 'Berlin, Germany' WHEN id % 4 = 1 THEN 'Rome, it' ELSE 'it' END AS locations,
  CASE WHEN id % 3 = 0 THEN 'REMOTE' WHEN id % 2 = 0 THEN 'HYBRID' WHEN id % 3 = 1 THEN 'ONSITE' ELSE 'UNKNOWN' END AS workplace_type, coalesce(department, 'Function') AS department,
  CASE WHEN idx < 50 AND id % 2 = 0 THEN url ELSE 'https://jobs.smartrecruiters.com/' || board_token || '/s' || id END AS url,
  CASE WHEN idx < 50 AND id % 2 = 0 THEN canonical_url ELSE 'https://jobs.smartrecruiters.com/' || board_token || '/s' || id END AS canonical_url,
  CASE WHEN idx < 50 THEN description || chr(10) || 'extra' || chr(10) || 'we' ELSE '' END AS description, first_seen::VARCHAR AS published FROM w"""))
def smartrecruiters_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = _listed(spark, sf_dir), F.col("id")
    ident = F.concat(F.lit("s"), key.cast("string"))
    place = F.struct(
        F.when(key % 4 == 1, " Rome ").alias("city"), F.lit("").alias("region"), F.lit("it").alias("country"), F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("remote"),
        (key % 2 == 0).alias("hybrid"), F.when(key % 4 == 0, " Berlin ,, Germany").alias("fullLocation"),
    )
    item = F.struct(ident.alias("id"), F.col("title").alias("name"), F.date_format("first_seen_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("releasedDate"), place.alias("location"), F.struct(F.col("department").alias("label")).alias("department"), F.struct(F.lit("Function").alias("label")).alias("function"))
    text = lambda c: F.struct(c.alias("text"))
    sections = F.struct(text(F.lit("<b>we</b>")).alias("companyDescription"), text(F.concat(F.lit("<p>"), "description", F.lit("</p>"))).alias("jobDescription"), text(F.lit(" ")).alias("qualifications"), text(F.lit("<i>extra</i>")).alias("additionalInformation"))
    raw = _paged(rows, "SMARTRECRUITERS", F.col("n_name"), 100, "totalFound", "content", item, ident, F.struct(F.when(key % 2 == 0, F.col("url")).alias("postingUrl"), F.struct(sections.alias("sections")).alias("jobAd")))
    return _fields(parse.snapshot(raw, ["SMARTRECRUITERS"])[0]).drop("compensation")


@_query(_sql("SELECT 'LEVER' AS ats, count(*) AS n FROM posting UNION ALL SELECT 'WORKDAY', count(*) FROM posting"))
def fetched_by_ats(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("external_id").alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"))
    raw = _board(spark, sf_dir, "LEVER", item).union(_workday(spark, sf_dir))
    return stats.fetched_by_ats(parse.snapshot(raw, ["LEVER", "WORKDAY"])[0])


# Boards, keys, days


_BOARDS = [config.Board("One", "LEVER", "acme"), config.Board("Two", "ASHBY", "acme"), config.Board("Three", "LEVER", "Other"), config.Board("", "WORKDAY", "t/wd1/s")]


@_query("SELECT * FROM (VALUES ('Three', 'LEVER', 'Other', 0), ('One', 'LEVER', 'acme', 1), ('Two', 'ASHBY', 'acme', 2)) v(company, ats, board_token, cfg_pos)")
def resolved_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.boards_frame(spark, config.resolve_boards(["lever:OTHER", "acme", "ASHBY:acme"], _BOARDS))


@_query(_sql("SELECT id, ats, CASE WHEN ats = 'WORKDAY' AND id % 2 = 0 THEN board_token || '/' || id WHEN id % 2 = 0 THEN '/' || id ELSE external_id END AS external_id FROM posting"))
def migrated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), F.col("id").cast("string"))).otherwise(F.col("external_id"))
    return lifecycle.migrated(postings(spark, sf_dir).withColumn("external_id", old)).select("id", "ats", "external_id")


@_query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN epoch(date_trunc('day', ts))::BIGINT END::VARCHAR AS day FROM events")
def start_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp_ntz")
    raw = F.when(F.col("event_id") % 4 == 0, F.date_format(t, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(start_of_day(raw)).cast("string").alias("day"))


# Text of pages


_ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_UNESCAPED = "coalesce(html, '')"
for _name, _char in _ENTITIES.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_char}')"


@_query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_UNESCAPED}, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<![^>]*>', '', 'gis'),
  '</?(?:p|li|br|html|head|title|body|nav|ul|div|article|h1|footer)\b[^>]*>', ' ', 'gis'), '</?[a-z][^>]*>', '', 'gis'), '[ \t\n\f\r]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL knows the tags and entities that the driver's pages have, but not entities that are cut before their `;`, as in
    some titles: it leaves these in the text."""
    return table(spark, sf_dir, "pages").select("page_id", to_text(F.col("html")).alias("text"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
