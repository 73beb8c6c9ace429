import pytest
from pyspark.sql import functions as F

from postingworks import config
from postingworks.functions import places, text, titles, tokens, urls, values
from postingworks.functions.html import plain_text
from postingworks.operators import scoring


@pytest.fixture
def one(spark):
    """The value of a column over one row (x)."""
    return lambda column, x, kind="string": spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("title, want", [
    ("Sr. Software Engineer", "senior software engineer"), ("SWE II - Payments (R12345)", "software engineer 2 payments"),
    ("C++/C# Dev", "c++ c# developer"), (" -- ", ""), (None, ""), ("Ops Mgr III", "operations manager 3"),
])
def test_titles(one, title, want):
    assert one(titles.normalize, title) == want == titles.normalize_text(title)


def test_title_sets(one):
    assert one(titles.tokens, "Engineer, Platform Engineer") == ["engineer", "platform"]
    assert one(lambda c: titles.levels(titles.tokens(c)), "Staff Engineer II") == ["staff", "2"]
    assert one(lambda c: titles.signature(titles.tokens(c)), "Engineering of the Analytics A 2 business") == ["engineer", "analytic", "2", "business"]
    for word, stem in (("engineering", "engineer"), ("campus", "campus"), ("king", "king"), ("business", "business")):
        assert one(titles.stem, word) == stem


@pytest.mark.parametrize("locations, want", [
    (["New York, NY (HQ)", "Remote (US)"], ["new york"]), (["On-site"], []), (["On-site - Austin, TX"], ["austin"]), (["US-Remote"], ["remote us"]),
    (["Florida, USA, Remote"], ["remote florida"]), (["Germany"], ["germany"]), (None, []), ([], []), (["Remote, EMEA"], ["remote", "remote emea"]), (["Washington, D.C."], ["washington", "d c"]),
])
def test_places(one, locations, want):
    assert one(places.keys, locations, "array<string>") == want


@pytest.mark.parametrize("url, want", [
    ("http://www.Example.com:80/Jobs/1/?utm_source=a&b=2&a=1#x", "https://example.com/Jobs/1?a=1&b=2"), ("https://u@example.com:8443/", "https://example.com:8443"),
    ("not a url with spaces", "not a url with spaces"), (" Relative/Path ", "relative/path"), (None, None), ("  ", None), ("https://e.co/x?REF=1", "https://e.co/x"),
])
def test_urls(one, url, want):
    assert one(urls.canonicalize, url) == want


@pytest.mark.parametrize("html, want", [
    ("&lt;h2&gt;&lt;b&gt;Who we are &lt;/b&gt;&lt;/h2&gt;&lt;p&gt;A &amp;amp; B&lt;/p&gt;", "Who we are A & B"),
    ("<ul><li>Java</li><li>Spring &amp; SQL</li></ul>", "Java Spring & SQL"), ("  ", ""), (None, ""), ("a<script>x</script>b<br>c", "ab c"),
])
def test_html(html, want):
    assert plain_text(html) == want


def test_references_named_without_their_semicolon():
    assert plain_text("<title>this&amp&amp;ver&amp</title><p>a&quot</p>") == 'this&&ver& a"'


def test_tokens(one):
    assert one(tokens.tokenize, "Use .NET, C++ and node.js - ok.") == ["Use", "NET", "C++", "and", "node.js", "ok"]
    assert one(lambda c: tokens.contains_phrase(c, "CI/CD"), "our ci cd") is True
    assert one(lambda c: tokens.contains_phrase(c, "Go", True), "go Gopher") is False


@pytest.mark.parametrize("body, want", [
    ("Go and golang", ["Go"]), ("go on", []), ("the rest of net revenue", [".NET", "REST"]), ("React Native, k8s", ["React", "React Native", "Kubernetes"]), ("", []), (None, []),
])
def test_skills(one, body, want):
    assert one(lambda c: scoring.skills_in(c, config.SkillDictionary()), body) == want


def test_score(spark):
    score = scoring.keyword_scorer(config.SkillDictionary(), config.PROFILE)
    row = spark.createDataFrame([("Backend Engineer", "Java, Rust, SQL"), ("Director, Backend", "Java")], "t string, d string").select(score(F.col("t"), F.col("d")).alias("s")).collect()
    a, b = row[0].s, row[1].s
    assert (a.score, a.coverage, a.title_match, a.skills, a.matched, a.missing) == (0.65, 0.5, True, ["Java", "Rust", "SQL"], ["Java", "SQL"], ["Rust"])
    assert b.score == 0 and b.title_excluded


def test_values(one, spark):
    assert one(text.round3, 0.7 * 29 / 40, "double") == 0.507
    row = spark.range(1).select(values.pay_range(F.lit("USD"), F.lit(120000.5), F.lit(150000.0), F.lit(None)), values.pay_range(F.lit("USD"), F.lit(None).cast("double"), F.lit(1.0), F.lit("x"))).first()
    assert list(row) == ["USD 120,001–150,000", None]
    assert one(values.offset_time, "2026-01-01") is None and one(values.instant, "2026-01-01T00:00:00Z") is not None
    assert one(lambda c: values.split_list(c), "a\nb\n\n") == ["a", "b"]


def test_config():
    boards = [config.Board("A", "LEVER", "a"), config.Board("", "ASHBY", "a"), config.Board("B", "LEVER", "b")]
    assert boards[1].name == "a"
    assert config.resolve_boards(["lever:A", "a"], boards) == [boards[0], boards[1]]
    with pytest.raises(ValueError):
        config.resolve_boards(["none"], boards)
    with pytest.raises(ValueError):
        config.SkillDictionary([config.Skill("a", "x"), config.Skill("A", "x")])
    assert config.SkillDictionary().validated(config.PROFILE) is config.PROFILE
