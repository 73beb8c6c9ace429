"""All queries of the engine over the driver's tables, each with SQL that gives the same rows where SQL can express it.

Lists are emitted as joined strings and times as epoch seconds, so that both engines print the same values.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config, schemas
from ..functions import places, titles, urls
from ..functions import text as T
from ..functions import tokens as K
from ..functions import values as V
from ..operators import dedup, evaluate, export, lifecycle, query, sampling, scoring, stats
from ..sources import parse
from . import recorded, views
from .views import POSTING_SQL, postings, sql_levels, sql_normalize, sql_round3, sql_signature, sql_tokens, sql_url, table

NOW = datetime(2000, 6, 1, tzinfo=timezone.utc)
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _with_posting(body: str, more: str = "") -> str:
    return f"WITH {POSTING_SQL}{more} {body}"


def seconds(c: str):
    """Epoch seconds; as text where they may be null, for some clients turn nullable integers into floats."""
    t = F.unix_seconds(F.col(c))
    return (t.cast("string") if c == "closed_at" else t).alias(c.removesuffix("_at"))


def _summary(df: DataFrame) -> DataFrame:
    """A page in the form that both engines print."""
    return df.select("id", "ats", "company", "title", F.array_join("locations", "|").alias("locations"), "workplace_type", "department", "url", "score", F.array_join("matched_skills", ",").alias("matched_skills"), seconds("first_seen_at"), seconds("closed_at"), "duplicate_of_id")


_SUMMARY_SQL = "id, ats, company, title, array_to_string(locations, '|') AS locations, workplace_type, department, url, score, array_to_string(matched_skills, ',') AS matched_skills, first_seen, closed::VARCHAR AS closed, duplicate_of_id"
_LIVE_SQL = "closed IS NULL AND duplicate_of_id IS NULL"


# Ranked reads


@_query(_with_posting(f"SELECT {_SUMMARY_SQL} FROM posting WHERE {_LIVE_SQL} AND score >= 0.25 ORDER BY score DESC NULLS LAST, first_seen DESC, id LIMIT 50"))
def ranked_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(query.page(postings(spark, sf_dir), query.Filter(min_score=0.25)))


@_query(_with_posting(f"SELECT {_SUMMARY_SQL} FROM posting WHERE duplicate_of_id IS NULL ORDER BY first_seen DESC, id LIMIT 20 OFFSET 40"))
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(query.page(postings(spark, sf_dir), query.Filter(status="ALL"), "NEWEST", 2, 20))


@_query(_with_posting(f"SELECT count(*) AS total_items, ceil(count(*) / 50.0)::BIGINT AS total_pages FROM posting WHERE {_LIVE_SQL}"))
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.page_totals(postings(spark, sf_dir))


@_query(_with_posting(f"SELECT id, normalized_title FROM posting WHERE {_LIVE_SQL} AND contains(normalized_title, 'senior software')"))
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).where(query.Filter(q="Sr. Software!").condition()).select("id", "normalized_title")


@_query(_with_posting("SELECT id, company, ats, closed::VARCHAR AS closed FROM posting WHERE closed IS NOT NULL AND duplicate_of_id IS NULL AND lower(company) = 'customer#000000007' AND ats = 'ASHBY' AND first_seen >= 631152000"))
def closed_of_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = query.Filter("CLOSED", since=query.parse_since("1990-01-01"), company=" CUSTOMER#000000007 ", ats="ASHBY")
    return postings(spark, sf_dir).where(f.condition()).select("id", "company", "ats", seconds("closed_at"))


@_query(_with_posting("SELECT id, title, description, last_seen, array_to_string(skills, ',') AS skills, array_to_string(list_filter(skills, lambda s: s NOT IN ('Java', 'SQL')), ',') AS missing_skills, (SELECT coalesce(array_to_string(list(id ORDER BY id), ','), '') FROM posting WHERE duplicate_of_id = 60) AS duplicate_ids FROM posting WHERE id = 60"))
def posting_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = query.detail(postings(spark, sf_dir), 60)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return d.select("id", "title", "description", seconds("last_seen_at"), join("skills"), join("missing_skills"), join("duplicate_ids"))


@_query(_with_posting("SELECT id, external_id FROM posting WHERE id > 1000 ORDER BY id LIMIT 500"))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.keyset_page(postings(spark, sf_dir).select("id", "external_id"), 1000)


@_query(_with_posting(
    "SELECT company, c.ats, c.board_token, coalesce(seen, 0)::BIGINT AS postings_seen, coalesce(opened, 0)::BIGINT AS open_postings, last_seen FROM configured c LEFT JOIN (SELECT ats, board_token, count(*) AS seen, count(*) FILTER (closed IS NULL) AS opened, max(last_seen) AS last_seen FROM posting GROUP BY 1, 2) s ON s.ats = c.ats AND s.board_token = c.board_token",
    ", configured AS (SELECT n_name AS company, 'GREENHOUSE' AS ats, n_name AS board_token FROM nation UNION ALL SELECT 'Nowhere', 'LEVER', 'nowhere')"))
def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"), F.lit("GREENHOUSE").alias("ats"), F.col("n_name").alias("board_token"), F.col("n_nationkey").alias("cfg_pos"))
    extra = config.boards_frame(spark, [config.Board("Nowhere", "LEVER", "nowhere")])
    return query.boards(postings(spark, sf_dir), own.unionByName(extra)).select("company", "ats", "board_token", "postings_seen", "open_postings", seconds("last_seen_at"))


# Statistics


@_query(_with_posting("SELECT count(*) FILTER (closed IS NULL AND duplicate_of_id IS NULL) AS open_postings, count(*) FILTER (closed IS NOT NULL) AS closed_postings, count(*) FILTER (closed IS NULL AND duplicate_of_id IS NOT NULL) AS open_duplicates FROM posting"))
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(postings(spark, sf_dir))


@_query(_with_posting(f"SELECT ats, count(*) AS n FROM posting WHERE {_LIVE_SQL} GROUP BY 1"))
def open_by_ats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.open_by(postings(spark, sf_dir), "ats")


@_query(_with_posting(f"SELECT workplace_type, count(*) AS n FROM posting WHERE {_LIVE_SQL} GROUP BY 1"))
def open_by_workplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.open_by(postings(spark, sf_dir), "workplace_type")


@_query(_with_posting(f"SELECT company, count(*) AS n FROM posting WHERE {_LIVE_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_companies(postings(spark, sf_dir))


@_query(_with_posting("SELECT ats, board_token, count(*) AS postings_seen, count(*) FILTER (closed IS NULL) AS open_postings, max(last_seen) AS last_seen FROM posting GROUP BY 1, 2"))
def board_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.board_summary(postings(spark, sf_dir)).select("ats", "board_token", "postings_seen", "open_postings", seconds("last_seen_at"))


_CATEGORIES = ", ".join(f"('{s.name}', '{s.category}')" for s in config.SKILLS)


@_query(_with_posting(
    f"SELECT skill, category, postings, {sql_round3('postings / total')} AS share FROM (SELECT unnest(skills) AS skill, count(*) AS postings FROM live GROUP BY 1) JOIN (SELECT count(*) AS total FROM live) ON true JOIN (VALUES {_CATEGORIES}) c(name, category) ON lower(name) = lower(skill) ORDER BY postings DESC, skill LIMIT 4",
    f", live AS (SELECT * FROM posting WHERE {_LIVE_SQL})"))
def skill_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.skill_demand(postings(spark, sf_dir), config.SkillDictionary().frame(spark), 4)


@_query(_with_posting(
    f"SELECT count(*) AS observed_closures, {sql_round3('quantile_cont(days, 0.5)')} AS median_days, {sql_round3('quantile_cont(days, 0.75)')} AS p75_days FROM (SELECT (closed - first_seen) / 86400.0::DOUBLE AS days FROM posting p JOIN b USING (ats, board_token) WHERE closed IS NOT NULL AND first_seen > begun)",
    ", b AS (SELECT ats, board_token, min(first_seen) AS begun FROM posting GROUP BY 1, 2)"))
def time_to_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.time_to_close(postings(spark, sf_dir))


@_query(_with_posting(f"SELECT count(*) AS new_openings FROM posting JOIN b USING (ats, board_token) WHERE first_seen > begun AND first_seen > {int(NOW.timestamp()) - 7 * 86400}", ", b AS (SELECT ats, board_token, min(first_seen) AS begun FROM posting GROUP BY 1, 2)"))
def new_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.new_openings(postings(spark, sf_dir), NOW)


@_query("WITH r AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS started, count(DISTINCT event_type)::INTEGER AS companies FROM events GROUP BY 1) SELECT count(*) AS runs, min(started) AS first_run, max(started) AS last_run, max_by(companies, started) AS last_run_boards FROM r")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _crawls(spark, sf_dir).groupBy("crawl").agg(F.count_distinct("board").cast("int").alias("companies_requested")).select(F.timestamp_seconds(F.col("crawl") * 86400).alias("started_at"), "companies_requested")
    return stats.crawl_summary(runs).select("runs", seconds("first_run_at"), seconds("last_run_at"), "last_run_boards")


# Titles, places, URLs, texts


@_query(_with_posting(f"SELECT id, normalized_title, array_to_string({sql_tokens('normalized_title')}, ' ') AS tokens FROM posting"))
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return p.select("id", "normalized_title", F.array_join(F.array_sort(titles.tokens_of(F.col("normalized_title"))), " ").alias("tokens"))


@_query(f"SELECT doc_id, {sql_normalize('left(text, 2000)')} AS normalized FROM documents".replace("left(text, 2000)", "text"))
def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", titles.normalize(F.col("text")).alias("normalized"))


@_query(_with_posting(f"SELECT id, array_to_string({sql_levels('t')}, ' ') AS levels, array_to_string({sql_signature('t')}, ' ') AS signature FROM (SELECT id, {sql_tokens('normalized_title')} AS t FROM posting)"))
def title_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = titles.tokens(F.col("title"))
    return postings(spark, sf_dir).select("id", F.array_join(F.array_sort(titles.levels(t)), " ").alias("levels"), F.array_join(F.array_sort(titles.signature(t)), " ").alias("signature"))


def _sql_level(s: str) -> str:
    near = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    return f"CASE WHEN {s} IN {near(places.MACRO_REGIONS)} THEN 1 WHEN {s} IN {near(places.COUNTRIES)} THEN 2 WHEN {s} IN {near(places.STATES)} OR length({s}) <= 2 THEN 3 ELSE 0 END"


_ALIAS_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in places.ALIASES.items())
_WORKPLACE_SQL = "[" + ", ".join(f"'{w}'" for w in places.WORKPLACE_WORDS) + "]"
_SEGMENTS_SQL = f"""list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(lower(l), '\\bon[\\s-]+site\\b', 'onsite', 'g'), '\\bin[\\s-]+office\\b', 'inoffice', 'g'), '[,;|/()\\-–•]+'),
  lambda s: trim(regexp_replace(regexp_replace(s, '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g'), '\\s+', ' ', 'g'))), lambda s: s <> ''), lambda s: regexp_replace(CASE s {_ALIAS_SQL} ELSE s END, ' province$', '')), lambda s: NOT list_contains({_WORKPLACE_SQL}, s))"""
KEYS_SQL = f"""
, loc AS (SELECT id, unnest(locations) AS l FROM posting), seg AS (SELECT id, {_SEGMENTS_SQL} AS p FROM loc),
lev AS (SELECT id, p, list_transform(p, lambda s: {_sql_level('s')}) AS v, list_filter(p, lambda s: ({_sql_level('s')}) = 0) AS cities FROM seg WHERE len(p) > 0),
per AS (SELECT id, cities, CASE WHEN v[-1] > 0 THEN cities[1:1] ELSE cities END AS picked,
  CASE WHEN len(cities) > 0 THEN [] ELSE list_transform(list_filter(p, lambda s: ({_sql_level('s')}) = list_max(v)), lambda s: CASE WHEN list_contains(p, 'remote') AND s <> 'remote' THEN 'remote ' || s ELSE s END) END AS regional FROM lev),
place_key AS (SELECT id, CASE WHEN sum(len(cities)) > 0 THEN list_sort(list_distinct(flatten(list(picked)))) ELSE list_sort(list_distinct(flatten(list(regional)))) END AS keys FROM per GROUP BY id)"""


@_query(_with_posting("SELECT id, array_to_string(keys, '|') AS keys FROM place_key", KEYS_SQL))
def location_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select("id", F.array_join(F.array_sort(places.keys(F.col("locations"))), "|").alias("keys"))


@_query(f"SELECT page_id, {sql_url('url')} AS canonical_url FROM pages")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("canonical_url"))


@_query("SELECT doc_id, CASE WHEN length(s) > 280 THEN left(s, 280) || '...' ELSE s END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_TOKENS_SQL = "list_filter(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{Nd}}+#.\\-]+'), lambda t: regexp_replace(t, '^[.-]+|[.-]+$', '', 'g')), lambda t: t <> '')"


@_query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS_SQL.format('text')} AS t FROM documents)")
def skill_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", K.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


# Frequent words of the driver's invented languages, as a dictionary of skills.
WORD_SKILLS = [config.Skill("the", "en", ("that",)), config.Skill("With", "en", (), ("The",)), config.Skill("of the", "en", ("in the", "of and the")), config.Skill("que", "fr", ("de la",)), config.Skill("und", "de", ("ich",)), config.Skill("ción", "es", ("los",))]


def _phrases_sql(dictionary: config.SkillDictionary) -> str:
    rows = ", ".join(f"({i}, '{dictionary.skills[i].name}', ' {p} ', {str(e).lower()})" for i, p, e in dictionary.phrases)
    return f"(VALUES {rows}) d(i, name, phrase, exact)"


def _skills_sql(source: str, key: str, text: str, dictionary: config.SkillDictionary) -> str:
    """padded texts joined with phrases: key, and names in dictionary order."""
    return (
        f"padded AS (SELECT {key}, ' ' || array_to_string({_TOKENS_SQL.format(text)}, ' ') || ' ' AS t FROM {source}), "
        f"hit AS (SELECT DISTINCT {key}, i, name FROM padded JOIN {_phrases_sql(dictionary)} ON CASE WHEN exact THEN contains(t, phrase) ELSE contains(lower(t), phrase) END), "
        f"found AS (SELECT {key}, list(name ORDER BY i) AS skills FROM hit GROUP BY 1)"
    )


@_query("WITH " + _skills_sql("documents", "doc_id", "text", config.SkillDictionary(WORD_SKILLS)) + " SELECT doc_id, coalesce(array_to_string(skills, ','), '') AS skills FROM padded LEFT JOIN found USING (doc_id)")
def document_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(scoring.skills_in(F.col("text"), config.SkillDictionary(WORD_SKILLS)), ",").alias("skills"))


@_query("WITH " + _skills_sql("documents", "doc_id", "text", config.SkillDictionary(WORD_SKILLS)) + " SELECT doc_id, name AS skill, i::INTEGER AS position FROM hit")
def document_skills_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = config.SkillDictionary(WORD_SKILLS)
    phrases = spark.createDataFrame([(p, e, d.skills[i].name, i) for i, p, e in d.phrases], "phrase string, exact boolean, skill string, position int")
    return scoring.skills_by_join(table(spark, sf_dir, "documents"), phrases, "doc_id", "text", 3)


_PROFILE = config.PROFILE
_MINE = "[" + ", ".join(f"'{s}'" for s in _PROFILE.skills) + "]"


def _any_phrase(phrases) -> str:
    return "(" + " OR ".join(f"contains(' ' || normalized_title || ' ', ' {titles.normalize_text(p)} ')" for p in phrases) + ")"


@_query(_with_posting(
    f"""SELECT id, {sql_round3(f"CASE WHEN {_any_phrase(_PROFILE.title_exclusions)} THEN 0.0::DOUBLE ELSE c * 0.7::DOUBLE + CASE WHEN {_any_phrase(_PROFILE.title_keywords)} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END END")} AS score,
    {sql_round3('c')} AS coverage, {_any_phrase(_PROFILE.title_keywords)} AS title_match, {_any_phrase(_PROFILE.title_exclusions)} AS title_excluded, array_to_string(s, ',') AS skills,
    array_to_string(list_filter(s, lambda x: list_contains({_MINE}, x)), ',') AS matched, array_to_string(list_filter(s, lambda x: NOT list_contains({_MINE}, x)), ',') AS missing
    FROM (SELECT id, normalized_title, coalesce(skills_found, []) AS s, len(list_filter(coalesce(skills_found, []), lambda x: list_contains({_MINE}, x)))::DOUBLE / (len(coalesce(skills_found, [])) + 1) AS c FROM posting LEFT JOIN (SELECT id, skills AS skills_found FROM found) USING (id))""",
    ", " + _skills_sql("posting", "id", "title || chr(10) || description", config.SkillDictionary())))
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.keyword_scorer(config.SkillDictionary(), _PROFILE)
    s = postings(spark, sf_dir).select("id", score(F.col("title"), F.col("description")).alias("s")).select("id", "s.*")
    return s.select("id", "score", "coverage", "title_match", "title_excluded", *[F.array_join(c, ",").alias(c) for c in ("skills", "matched", "missing")])


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE trim('USD ' || format('{:,}', floor(o_totalprice + 0.5)::BIGINT) || '–' || format('{:,}', floor(o_totalprice + 0.5)::BIGINT + 1000) || CASE WHEN o_orderkey % 2 = 0 THEN ' per-year' ELSE ' ' END) END AS pay FROM orders")
def pay_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    low = F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") + 0.5).cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), V.pay_range(F.lit("USD"), low, low + 1000, F.when(F.col("o_orderkey") % 2 == 0, "per-year")).alias("pay"))


_KINDS = ["On-site", " in_office ", "Hybrid", "REMOTE", "Flexible", "Remote - office"]


@_query(f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ONSITE' WHEN 1 THEN 'ONSITE' WHEN 2 THEN 'HYBRID' WHEN 3 THEN 'REMOTE' ELSE 'UNKNOWN' END AS word, CASE event_id % 6 WHEN 0 THEN 'ONSITE' WHEN 1 THEN 'ONSITE' WHEN 2 THEN 'HYBRID' WHEN 3 THEN 'REMOTE' WHEN 4 THEN 'HYBRID' ELSE 'REMOTE' END AS phrase FROM events")
def workplace_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.pick(_KINDS, F.col("event_id") % 6)
    return table(spark, sf_dir, "events").select("event_id", V.workplace(raw).alias("word"), V.workplace_of_phrase(raw).alias("phrase"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT - CASE event_id % 3 WHEN 1 THEN 19800 ELSE 0 END END::VARCHAR AS published, epoch(date_trunc('day', ts))::BIGINT AS day FROM events")
def published_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.concat(text, F.element_at(F.array(F.lit("Z"), F.lit("+05:30"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")))
    day = F.unix_seconds(V.start_of_day(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd")))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(V.offset_time(raw)).cast("string").alias("published"), day.alias("day"))


@_query(_with_posting("SELECT ats || ':' || external_id AS key, ats AS key_ats, external_id AS key_id, array_to_string(locations, chr(10)) AS stored, len(locations)::BIGINT AS n_locations, CASE WHEN ats = 'WORKDAY' THEN board_token || '/' || external_id ELSE '/' || external_id END AS scoped FROM posting"))
def storage_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).withColumn("key", V.posting_key(F.col("ats"), F.col("external_id")))
    ats, ident = V.key_parts(F.col("key"))
    stored = V.joined_list(F.col("locations"))
    return p.select("key", ats.alias("key_ats"), ident.alias("key_id"), stored.alias("stored"), F.size(V.split_list(stored)).cast("long").alias("n_locations"), V.board_scoped_id(F.col("ats"), F.col("board_token"), F.concat(F.lit("/"), F.col("external_id"))).alias("scoped"))


# Duplicates

_DEDUP_SQL = """
, cand AS (
  SELECT p.id, lower(trim(company)) AS company, canonical_url, {sig} AS sig, {lev} AS lev, coalesce(keys, []) AS keys, lower(trim(department)) AS dep
  FROM posting p LEFT JOIN place_key USING (id) WHERE closed IS NULL
), url AS (SELECT *, first_value(id) OVER (PARTITION BY canonical_url ORDER BY id) AS owner FROM cand),
surv AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY id) AS rn FROM url WHERE id = owner),
step AS (
  SELECT company, rn, id, NULL::BIGINT AS leader, 0.0::DOUBLE AS sim, [{{'id': id, 'sig': sig, 'lev': lev, 'keys': keys, 'dep': dep}}] AS leaders FROM surv WHERE rn = 1
  UNION ALL
  SELECT company, rn, id, m.id, coalesce(m.sim, 0.0), CASE WHEN m IS NULL THEN list_append(leaders, {{'id': id, 'sig': sig, 'lev': lev, 'keys': keys, 'dep': dep}}) ELSE leaders END FROM (
    SELECT x.company, x.rn, x.id, x.sig, x.lev, x.keys, x.dep, s.leaders,
      list_sort(list_filter(list_transform(s.leaders, lambda l, k: {{'neg': -(CASE WHEN len(l.sig) + len(x.sig) = 0 THEN 1.0 ELSE len(list_intersect(l.sig, x.sig))::DOUBLE / len(list_distinct(list_concat(l.sig, x.sig))) END), 'k': k, 'id': l.id,
        'sim': CASE WHEN len(l.sig) + len(x.sig) = 0 THEN 1.0 ELSE len(list_intersect(l.sig, x.sig))::DOUBLE / len(list_distinct(list_concat(l.sig, x.sig))) END,
        'ok': l.lev = x.lev AND list_has_any(l.keys, x.keys) AND (l.dep IS NULL OR x.dep IS NULL OR l.dep = x.dep)}}), lambda l: l.ok AND l.sim >= {threshold}))[1] AS m
    FROM step s JOIN surv x ON x.company = s.company AND x.rn = s.rn + 1)
), fuzzy AS (SELECT id, leader, sim FROM step),
exact AS (SELECT u.id, u.owner, CASE WHEN len(u.sig) + len(o.sig) = 0 THEN 1.0 ELSE len(list_intersect(u.sig, o.sig))::DOUBLE / len(list_distinct(list_concat(u.sig, o.sig))) END AS sim FROM url u JOIN cand o ON o.id = u.owner WHERE u.id <> u.owner)
"""
_LINKS_SQL = "SELECT id AS duplicate_id, leader AS canonical_id, 'FUZZY' AS reason, {0} AS title_similarity FROM fuzzy WHERE leader IS NOT NULL UNION ALL SELECT e.id, coalesce(f.leader, owner), 'EXACT_URL', {1} FROM exact e LEFT JOIN fuzzy f ON f.id = e.owner".format(sql_round3("sim"), sql_round3("e.sim"))


def _dedup_sql(threshold: float, body: str) -> str:
    tokens = sql_tokens("normalized_title")
    more = KEYS_SQL + _DEDUP_SQL.format(sig=sql_signature(tokens), lev=sql_levels(tokens), threshold=threshold)
    return "WITH RECURSIVE " + POSTING_SQL + more + " " + body


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.open_candidates(postings(spark, sf_dir))


@_query(_dedup_sql(1.0, _LINKS_SQL))
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedupe(_candidates(spark, sf_dir)).withColumn("title_similarity", T.round3(F.col("title_similarity")))


@_query(_dedup_sql(0.6, _LINKS_SQL))
def duplicate_links_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedupe(_candidates(spark, sf_dir), 0.6).withColumn("title_similarity", T.round3(F.col("title_similarity")))


@_query(_dedup_sql(1.0, "SELECT (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM exact) AS exact_duplicates, (SELECT count(leader) FROM fuzzy) AS fuzzy_duplicates, (SELECT sum(n)::BIGINT FROM (SELECT coalesce(sum(CASE WHEN leader IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY company ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM step)) AS pairs_compared"))
def dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_metrics(_candidates(spark, sf_dir))


@_query(_dedup_sql(1.0, f"SELECT p.id, coalesce(l.canonical_id, NULL) AS duplicate_of_id, l.reason AS dedup_reason FROM posting p LEFT JOIN ({_LINKS_SQL}) l ON l.duplicate_id = p.id"))
def linked_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return dedup.with_links(p, dedup.dedupe(dedup.open_candidates(p))).select("id", "duplicate_of_id", "dedup_reason")


_PAIRS_SQL = """
, t AS (SELECT p.id, lower(trim(company)) AS company, {tok} AS tok, {sig} AS sig, {lev} AS lev, coalesce(keys, []) AS keys, lower(trim(department)) AS dep FROM posting p LEFT JOIN place_key USING (id) WHERE closed IS NULL),
pair AS (SELECT a.company AS company_key, a.id AS a_id, b.id AS b_id, CASE WHEN len(a.tok) + len(b.tok) = 0 THEN 1.0 ELSE len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok))) END AS sim,
  a.sig = b.sig AND a.lev = b.lev AND list_has_any(a.keys, b.keys) AND (a.dep IS NULL OR b.dep IS NULL OR a.dep = b.dep) AS predicted FROM t a JOIN t b ON a.company = b.company AND a.id < b.id),
near AS (SELECT *, CASE WHEN predicted THEN 'predicted' WHEN sim >= 0.9 THEN 'near_0.9' WHEN sim >= 0.7 THEN 'near_0.7' ELSE 'near_0.5' END AS stratum FROM pair WHERE sim >= 0.5)"""


def _pairs_sql(body: str) -> str:
    tokens = sql_tokens("normalized_title")
    return _with_posting(body, KEYS_SQL + _PAIRS_SQL.format(tok=tokens, sig=sql_signature(tokens), lev=sql_levels(tokens)))


@_query(_pairs_sql(f"SELECT company_key, a_id, b_id, {sql_round3('sim')} AS title_similarity, stratum FROM near"))
def company_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.company_pairs(_candidates(spark, sf_dir)).withColumn("title_similarity", T.round3(F.col("title_similarity")))


@_query(_pairs_sql("SELECT stratum, least(count(*), q)::BIGINT AS n, round(count(*) / least(count(*), q)::DOUBLE, 6) AS weight FROM near JOIN (VALUES ('predicted', 50), ('near_0.9', 17), ('near_0.7', 17), ('near_0.5', 16)) v(stratum, q) USING (stratum) GROUP BY stratum, q"))
def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sampling.stratified_sample(sampling.company_pairs(_candidates(spark, sf_dir)))
    return s.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@_query(_pairs_sql("SELECT a_id, b_id FROM near WHERE stratum = 'predicted' AND (a_id + b_id) % 4 <> 0"))
def pairs_not_labelled_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sampling.company_pairs(_candidates(spark, sf_dir)).where("stratum = 'predicted'")
    earlier = pairs.where("(a_id + b_id) % 4 = 0").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return sampling.without_pairs(pairs, earlier).select("a_id", "b_id")


@_query(_pairs_sql("SELECT a_id, b_id, predicted OR a.canonical_url = b.canonical_url AS predicted FROM near JOIN posting a ON a.id = a_id JOIN posting b ON b.id = b_id"))
def pair_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _candidates(spark, sf_dir)
    url = lambda side: p.select(F.col("id").alias(f"{side}_id"), F.col("canonical_url").alias(f"{side}_url"))
    pairs = sampling.company_pairs(p).join(url("a"), "a_id").join(url("b"), "b_id")
    return pairs.select("a_id", "b_id", evaluate.predicts(F.col("a_url"), F.col("b_url"), F.col("stratum") == sampling.STRATA[0]).alias("predicted"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0
    return l.select((F.col("quality") == 1).alias("duplicate"), (F.col("doc_id") % 5 + 1).cast("double").alias("weight"), score.alias("similarity"), F.when(F.col("doc_id") % 3 == 0, "predicted").otherwise("near_0.5").alias("stratum"), (score >= 0.5).alias("predicted"))


_LABELLED_SQL = "WITH l AS (SELECT quality = 1 AS d, (doc_id % 5 + 1)::DOUBLE AS w, (doc_id * 37 % 101) / 100.0::DOUBLE AS s, CASE WHEN doc_id % 3 = 0 THEN 'predicted' ELSE 'near_0.5' END AS stratum FROM labels)"


@_query(_LABELLED_SQL + f", c AS (SELECT coalesce(sum(w) FILTER (d AND s >= 0.5), 0) AS tp, coalesce(sum(w) FILTER (NOT d AND s >= 0.5), 0) AS fp, coalesce(sum(w) FILTER (d AND s < 0.5), 0) AS fn, coalesce(sum(w) FILTER (NOT d AND s < 0.5), 0) AS tn FROM l) SELECT tp, fp, fn, tn, {sql_round3('tp / (tp + fp)')} AS precision, {sql_round3('tp / (tp + fn)')} AS recall FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluate.confusion(_labelled(spark, sf_dir))
    return c.select("tp", "fp", "fn", "tn", T.round3(F.col("precision")).alias("precision"), T.round3(F.col("recall")).alias("recall"))


_Z = evaluate.Z95


@_query(_LABELLED_SQL + f", c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (d)::DOUBLE AS k FROM l WHERE stratum = 'predicted') SELECT n::BIGINT AS labelled, k::BIGINT AS correct, {sql_round3('k / n')} AS precision, {sql_round3(f'greatest(0, (k / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n))')} AS low, {sql_round3(f'least(1, (k / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n))')} AS high FROM c")
def predicted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.predicted_precision(_labelled(spark, sf_dir))
    return p.select("labelled", "correct", *[T.round3(F.col(c)).alias(c) for c in ("precision", "low", "high")])


@_query(_LABELLED_SQL + f" SELECT threshold, {sql_round3('coalesce(sum(w) FILTER (d AND s >= threshold), 0) / sum(w) FILTER (s >= threshold)')} AS precision, {sql_round3('coalesce(sum(w) FILTER (d AND s >= threshold), 0) / sum(w) FILTER (d)')} AS recall FROM l, (VALUES (0.25::DOUBLE), (0.5), (0.75)) v(threshold) GROUP BY threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.sweep(_labelled(spark, sf_dir), [0.25, 0.5, 0.75], lambda t: F.col("similarity") >= t)
    return s.select("threshold", T.round3(F.col("precision")).alias("precision"), T.round3(F.col("recall")).alias("recall"))


@_query("SELECT o_orderpriority AS config, floor(quantile_cont(floor(o_totalprice)::BIGINT, 0.5))::BIGINT AS median FROM orders GROUP BY 1")
def run_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), F.floor("o_totalprice").alias("ms"))
    return evaluate.median_of_runs(runs, "ms", ["config"])


# Lifecycle


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(views.epoch("ts") / 86400).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("board"), F.col("user_id").alias("posting"), day.alias("crawl"))


def _crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sightings(spark, sf_dir).select("board", "crawl").distinct().withColumn("complete", F.col("crawl") % 3 != 0)


@_query("""WITH s AS (SELECT DISTINCT event_type AS board, user_id AS posting, epoch(ts)::BIGINT // 86400 AS crawl FROM events), c AS (SELECT DISTINCT board, crawl, crawl % 3 <> 0 AS complete FROM s),
st AS (SELECT board, posting, crawl, lag(crawl) OVER (PARTITION BY board, posting ORDER BY crawl) AS prev FROM s),
k AS (SELECT st.*, EXISTS (SELECT 1 FROM c WHERE c.board = st.board AND c.complete AND c.crawl > st.prev AND c.crawl < st.crawl) AS closed_between FROM st)
SELECT board, posting, min(crawl) AS first_seen, max(crawl) AS last_seen, (SELECT min(crawl) FROM c WHERE c.board = k.board AND c.complete AND c.crawl > max(k.crawl)) AS closed_at,
count(*) FILTER (prev IS NOT NULL AND NOT closed_between) AS n_updated, count(*) FILTER (closed_between) AS n_reopened,
count(*) FILTER (closed_between) + CASE WHEN (SELECT min(crawl) FROM c WHERE c.board = k.board AND c.complete AND c.crawl > max(k.crawl)) IS NOT NULL THEN 1 ELSE 0 END AS n_closed FROM k GROUP BY board, posting""")
def lifecycle_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.history(_sightings(spark, sf_dir), _crawls(spark, sf_dir))


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: orders up to key 3 of 4; listed now: those not divisible by 5, new ones among them; the board of ASHBY is incomplete."""
    p = postings(spark, sf_dir)
    state = p.where("id % 4 <> 3")
    columns = ["ats", "external_id", "company", "title", "locations", "department", "url", "canonical_url", "compensation", "source_published_at", "board_token"]
    listed = p.where("id % 5 <> 0").select(*columns, F.when(F.col("id") % 2 == 0, "UNKNOWN").otherwise(F.col("workplace_type")).alias("workplace_type"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.upper("description")).alias("description"), F.hash("ats", "board_token").alias("cfg_pos"), F.col("id").alias("pos"))
    fetched = p.select("ats", "board_token").distinct().where("ats <> 'LEVER'").withColumn("complete", F.col("ats") != "ASHBY")
    listed = listed.join(fetched.select("ats", "board_token"), ["ats", "board_token"], "left_semi")
    return lifecycle.sync(state, listed, fetched, NOW)


_SYNC_SQL = f"""SELECT external_id, ats, CASE WHEN here AND NOT stored THEN 'created' WHEN here AND closed IS NULL THEN 'updated' WHEN here THEN 'reopened' WHEN stored AND closed IS NULL AND ats NOT IN ('LEVER', 'ASHBY') THEN 'closed' END AS change,
  CASE WHEN here AND (id % 2 <> 0 OR NOT stored) THEN CASE WHEN id % 2 = 0 THEN 'UNKNOWN' ELSE workplace_type END ELSE workplace_type END AS workplace_type,
  CASE WHEN NOT here THEN description WHEN id % 3 = 0 THEN CASE WHEN stored THEN description ELSE ' ' END ELSE upper(description) END AS description,
  CASE WHEN stored THEN first_seen ELSE {int(NOW.timestamp())} END AS first_seen, CASE WHEN here THEN {int(NOW.timestamp())} ELSE last_seen END AS last_seen,
  CASE WHEN here THEN NULL WHEN closed IS NULL AND ats NOT IN ('LEVER', 'ASHBY') THEN {int(NOW.timestamp())} ELSE closed END::VARCHAR AS closed
  FROM (SELECT *, id % 4 <> 3 AS stored, id % 5 <> 0 AND ats <> 'LEVER' AS here FROM posting) WHERE here OR stored"""


@_query(_with_posting(_SYNC_SQL))
def board_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).select("external_id", "ats", "change", "workplace_type", "description", seconds("first_seen_at"), seconds("last_seen_at"), seconds("closed_at"))


@_query(_with_posting(f"SELECT count(*) FILTER (change = 'created') AS created, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'reopened') AS reopened, count(*) FILTER (change = 'closed') AS closed FROM ({_SYNC_SQL})"))
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.total_counts(lifecycle.sync_counts(_synced(spark, sf_dir)))


@_query(_with_posting("SELECT ats, external_id, count(DISTINCT board_token) AS n_boards FROM (SELECT ats, 'x' || (id % 3000) AS external_id, board_token FROM posting) GROUP BY 1, 2 HAVING count(DISTINCT board_token) > 1"))
def clashing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).select("ats", F.concat(F.lit("x"), (F.col("id") % 3000).cast("string")).alias("external_id"), "board_token")
    return lifecycle.clashing_keys(p)


# Sources: bodies are made from the tables, then parsed again


def _bodies(rows: DataFrame, ats: str, body) -> DataFrame:
    """RAW rows of one board a nation, in parts."""
    none = F.lit(None).cast("string")
    return rows.select(F.lit(ats).alias("ats"), F.col("n_name").alias("company"), F.col("n_name").alias("board_token"), F.col("n_nationkey").alias("cfg_pos"), F.lit("board").alias("kind"), "place", none.alias("item"), body.alias("body"), none.alias("error"))


def _jobs(spark: SparkSession, sf_dir: str, item) -> DataFrame:
    p = postings(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    return p.groupBy("board_token", views.part_of("id").alias("place")).agg(F.array_sort(F.collect_list(item)).alias("jobs")).join(nation, F.col("board_token") == F.col("n_name")).drop("board_token")


_PARSED_SQL = "array_to_string(locations, '|') AS locations, department, url, canonical_url, description"


@_query(_with_posting("SELECT board_token, id::VARCHAR AS external_id, title, array_to_string(locations[1:1], '|') AS locations, CASE WHEN contains(lower(locations[1]), 'remote') THEN 'REMOTE' ELSE 'UNKNOWN' END AS workplace_type, department, url, canonical_url, description, first_seen AS published FROM posting WHERE id % 9 <> 0"))
def greenhouse_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("id", F.when(F.col("id") % 9 == 0, "  ").otherwise(F.col("title")).alias("title"), F.col("url").alias("absolute_url"), F.struct(F.get("locations", F.lit(0)).alias("name")).alias("location"), F.array(F.struct(F.lit(" ").alias("name")), F.struct(F.col("department").alias("name"))).alias("departments"), F.date_format(F.col("first_seen_at"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("first_published"), F.concat(F.lit("&lt;p&gt;"), F.col("description"), F.lit("&lt;/p&gt;")).alias("content"))
    good, _ = parse.snapshot(_bodies(_jobs(spark, sf_dir, item), "GREENHOUSE", F.to_json(F.struct("jobs"))), ["GREENHOUSE"])
    return good.select("board_token", "external_id", "title", F.array_join("locations", "|").alias("locations"), "workplace_type", "department", "url", "canonical_url", "description", F.unix_seconds("source_published_at").alias("published"))


@_query(_with_posting("SELECT board_token, count(*) FILTER (id % 9 = 0) = 0 AND board_token <> 'NATION_3' AS complete, CASE WHEN board_token <> 'NATION_3' AND count(*) FILTER (id % 9 = 0) > 0 THEN count(*) FILTER (id % 9 = 0) || ' postings could not be parsed' END AS reason, board_token <> 'NATION_3' AS ok FROM posting GROUP BY 1"))
def board_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("id", F.when(F.col("id") % 9 == 0, "  ").otherwise(F.col("title")).alias("text"), F.lit("http://a.example/b").alias("hostedUrl"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("ident"))
    jobs = _jobs(spark, sf_dir, item)
    listed = F.transform("jobs", lambda j: F.struct(j["ident"].alias("id"), j["text"].alias("text"), j["hostedUrl"].alias("hostedUrl")))
    body = F.when(F.col("n_name") == "NATION_3", "<html>").otherwise(F.to_json(listed))
    _, boards = parse.snapshot(_bodies(jobs, "LEVER", body), ["LEVER"])
    return boards.select("board_token", "complete", F.when(F.col("ok"), F.col("reason")).alias("reason"), "ok")


# Export


_ISO_SQL = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"


@_query(_with_posting(f"SELECT id, json_object('posting', json_object('id', id, 'ats', ats, 'company', company, 'title', title, 'locations', locations, 'workplaceType', workplace_type, 'department', department, 'url', url, 'score', score, 'matchedSkills', matched_skills, 'firstSeenAt', {_ISO_SQL.format('first_seen')}, 'closedAt', NULL, 'duplicateOfId', NULL), 'description', description, 'compensation', NULL)::VARCHAR AS json FROM posting WHERE {_LIVE_SQL} AND score >= 0.5"))
def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc = spark.conf.get("spark.sql.session.timeZone") == "UTC"
    rows = postings(spark, sf_dir)
    if not utc:  # instants print in UTC whatever the session's zone
        zone = F.current_timezone()
        rows = rows.withColumns({c: F.convert_timezone(zone, F.lit("UTC"), F.col(c).cast("timestamp_ntz")) for c in ("first_seen_at", "closed_at")})
    return export.export_rows(rows, 0.5)


@cache
def queries() -> dict:
    return _QUERIES | recorded.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | recorded.oracle_sql()


__all__ = ["queries", "oracle_sql", "schemas"]
