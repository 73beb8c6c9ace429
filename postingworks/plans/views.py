"""Postings made from the driver's tables, once in Spark and once in SQL, so that queries can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ATS_ORDER
from ..functions import titles, urls
from ..functions.text import strings

LEVEL = {"1-URGENT": "Senior ", "2-HIGH": "Sr. ", "3-MEDIUM": "Staff ", "4-NOT SPECIFIED": "Jr "}
ROLES = ["Software Engineer", "Backend Engineers", "Data Engineering Lead", "SWE II, Payments"]
CITIES = ["New York, NY", "San Francisco, CA (HQ)", "Remote - US", "Berlin, Germany", "Toronto, ON"]
SKILL_TEXT = ["Java and SQL", "Python 3", "Go", "golang go", "node.js", "React Native", "CI/CD", "PostgreSQL", "k8s", "the rest", "net revenue", "C++", "machine learning"]
WORKPLACES = ["REMOTE", "HYBRID", "ONSITE", "UNKNOWN"]
SKILLS = ["Java", "Python", "SQL", "Docker", "AWS"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone; to the nearest second, of two equally
    near ones the even one, as the SQL's epoch()::BIGINT is."""
    return F.expr(f"cast(rint(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) / 1000000D) as long)")


#: Ids of which the postings of a board share a body: no row of a recording grows with the tables.
PART = 10_000


def part_of(key: str):
    """First id of the part that a posting's id is in."""
    return F.col(key) - F.pmod(F.col(key), F.lit(PART))


def pick(values: list[str], index):
    return F.element_at(strings(values), (index + 1).cast("int"))


#: Folders of postings that are stored already, by the folder of their tables.
_stored: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes the postings once; from then on `postings` reads them, as queries read a store."""
    _stored.pop(sf_dir, None)
    postings(spark, sf_dir).write.mode("overwrite").parquet(path)
    _stored[sf_dir] = path


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STATE columns: one posting an order; 'F' orders are closed when their last line ships."""
    if sf_dir in _stored:
        return spark.read.parquet(_stored[sf_dir])
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"), F.min("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(shipped, "o_orderkey", "left").join(part, "p_partkey", "left")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv]), F.col("o_orderpriority")), F.lit(""))
    title = F.concat(level, pick(ROLES, key % 4), F.when(key % 7 == 0, F.concat(F.lit(" (R"), (key + 10000).cast("string"), F.lit(")"))).otherwise(""))
    url = F.concat(F.lit("http://www.Boards.example.com/"), F.regexp_replace("c_name", "#", "-"), F.lit("/jobs/"), F.when(key % 20 < 2, F.floor(key / 20) * 20).otherwise(key).cast("string"), F.lit("/?utm_source=x&b=2&a=1#apply"))
    first = epoch("o_orderdate")
    skills = F.filter(F.array(*[F.when(F.floor(key / (1 << i)) % 2 == 1, F.lit(s)) for i, s in enumerate(SKILLS)]), lambda s: s.isNotNull())
    base = j.select(
        key.alias("id"), pick(ATS_ORDER, cust % 5).alias("ats"), F.col("n_name").alias("board_token"), F.concat(F.lit("x"), key.cast("string")).alias("external_id"), F.col("c_name").alias("company"), title.alias("title"),
        F.when(key % 3 == 0, F.array(pick(CITIES, cust % 5), F.lit("Remote (US)"))).otherwise(F.array(pick(CITIES, cust % 5))).alias("locations"),
        pick(WORKPLACES, key % 4).alias("workplace_type"), F.when(key % 5 == 0, None).otherwise(F.col("p_brand")).alias("department"), url.alias("url"),
        F.concat(F.lit("We use "), pick(SKILL_TEXT, key % 13), F.lit(", "), pick(SKILL_TEXT, (key * 5 + 3) % 13), F.lit(".")).alias("description"),
        F.timestamp_seconds(first).alias("first_seen_at"), F.timestamp_seconds(first + 86400 * (key % 30)).alias("last_seen_at"),
        F.when(F.col("o_orderstatus") == "F", F.timestamp_seconds(F.greatest(F.coalesce(epoch("ship"), first), first) + key % 86400)).alias("closed_at"),
        F.when(key % 20 == 1, key - 1).alias("duplicate_of_id"), F.when(key % 11 != 0, (key * 37 % 1001) / 1000.0).alias("score"), skills.alias("skills"),
    )
    none = F.lit(None)
    return base.withColumns(
        {
            "normalized_title": titles.normalize(F.col("title")), "canonical_url": urls.canonicalize(F.col("url")), "compensation": none.cast("string"), "source_published_at": none.cast("timestamp"),
            "dedup_reason": F.when(F.col("duplicate_of_id").isNotNull(), "EXACT_URL"), "matched_skills": F.array_intersect("skills", strings(["Java", "SQL"])),
        }
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_normalize(x: str) -> str:
    table = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in titles.ABBREVIATIONS.items())
    flat = f"string_split(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}+#]+', ' ', 'g'), ' ')"
    return f"array_to_string(list_transform(list_filter({flat}, lambda w: w <> '' AND NOT regexp_full_match(w, '[a-z]{{1,3}}[0-9]{{4,}}')), lambda w: CASE w {table} ELSE w END), ' ')"


def sql_tokens(normal: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({normal}, ' '), lambda w: w <> '')))"


def sql_levels(tokens: str) -> str:
    return f"list_sort(list_intersect({tokens}, {_sql_list(titles.LEVELS)}))"


def sql_stem(w: str) -> str:
    return f"CASE WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN left({w}, length({w}) - 3) WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' THEN left({w}, length({w}) - 1) ELSE {w} END"


def sql_signature(tokens: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter({tokens}, lambda w: NOT list_contains({_sql_list(titles.STOP_WORDS)}, w) AND NOT regexp_full_match(w, '\\p{{L}}')), lambda w: {sql_stem('w')})))"


def sql_round3(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE"


def sql_url(u: str) -> str:
    """For http(s) URLs with a plain host, as the driver's tables have them."""
    kept = f"list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: trim(p) <> '' AND NOT starts_with(lower(string_split(p, '=')[1]), 'utm_') AND NOT list_contains({_sql_list(urls.TRACKING)}, lower(string_split(p, '=')[1]))))"
    return (
        f"'https://' || regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"
        f" || CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"
    )


def _case(column: str, values: list[str]) -> str:
    return f"({_sql_list(values)})[({column} + 1)::INTEGER]"


POSTING_SQL = f"""
raw_posting AS (
  SELECT o_orderkey AS id, {_case('o_custkey % 5', ATS_ORDER)} AS ats, n_name AS board_token, 'x' || o_orderkey AS external_id, c_name AS company,
    CASE o_orderpriority {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in LEVEL.items())} ELSE '' END || {_case('o_orderkey % 4', ROLES)} || CASE WHEN o_orderkey % 7 = 0 THEN ' (R' || (o_orderkey + 10000) || ')' ELSE '' END AS title,
    CASE WHEN o_orderkey % 3 = 0 THEN [{_case('o_custkey % 5', CITIES)}, 'Remote (US)'] ELSE [{_case('o_custkey % 5', CITIES)}] END AS locations,
    {_case('o_orderkey % 4', WORKPLACES)} AS workplace_type, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE p_brand END AS department,
    'http://www.Boards.example.com/' || replace(c_name, '#', '-') || '/jobs/' || CASE WHEN o_orderkey % 20 < 2 THEN o_orderkey // 20 * 20 ELSE o_orderkey END || '/?utm_source=x&b=2&a=1#apply' AS url,
    'We use ' || {_case('o_orderkey % 13', SKILL_TEXT)} || ', ' || {_case('(o_orderkey * 5 + 3) % 13', SKILL_TEXT)} || '.' AS description,
    epoch(o_orderdate)::BIGINT AS first_seen, epoch(o_orderdate)::BIGINT + 86400 * (o_orderkey % 30) AS last_seen,
    CASE WHEN o_orderstatus = 'F' THEN greatest(coalesce(epoch(ship)::BIGINT, 0), epoch(o_orderdate)::BIGINT) + o_orderkey % 86400 END AS closed,
    CASE WHEN o_orderkey % 20 = 1 THEN o_orderkey - 1 END AS duplicate_of_id, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 37 % 1001) / 1000.0::DOUBLE END AS score,
    list_filter([{', '.join(f"CASE WHEN o_orderkey // {1 << i} % 2 = 1 THEN '{s}' END" for i, s in enumerate(SKILLS))}], lambda s: s IS NOT NULL) AS skills
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship, min(l_partkey) AS part FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = part
), posting AS (
  SELECT *, {sql_normalize('title')} AS normalized_title, {sql_url('url')} AS canonical_url, list_filter(skills, lambda s: s IN ('Java', 'SQL')) AS matched_skills FROM raw_posting
)"""
