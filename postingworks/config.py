"""Boards, the skill dictionary, the ranking profile and the engine's settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.text import strings
from .functions.tokens import phrase_tokens

#: Fixed value: the sources, in the order that breaks ties between postings.
ATS_ORDER = ["GREENHOUSE", "LEVER", "ASHBY", "WORKDAY", "SMARTRECRUITERS"]


def ats_rank(ats: Column) -> Column:
    return F.array_position(strings(ATS_ORDER), ats)


@dataclass(frozen=True)
class Settings:
    max_details: int = 50
    title_similarity: float = 1.0
    requests_per_second: float = 2.0
    burst: int = 2
    connect_timeout_s: float = 5.0
    request_timeout_s: float = 30.0
    max_attempts: int = 4
    base_delay_ms: int = 500
    max_delay_ms: int = 8000
    max_retry_after_s: int = 60
    pool_size: int = 16


@dataclass(frozen=True)
class Board:
    name: str
    ats: str
    token: str

    def __post_init__(self):
        if not self.token or not self.token.strip():
            raise ValueError("a board needs a token")
        if self.ats not in ATS_ORDER:
            raise ValueError(f"unknown source: {self.ats}")
        if not self.name or not self.name.strip():
            object.__setattr__(self, "name", self.token)


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    skills: tuple[str, ...] = ()
    title_keywords: tuple[str, ...] = ()
    title_exclusions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Skill:
    name: str
    category: str
    aliases: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()


# Skills as name, category, spellings in any case and spellings in exact case.
SKILLS = [
    Skill("Java", "language", ("java",)), Skill("Kotlin", "language"), Skill("Scala", "language"), Skill("Python", "language"),
    Skill("JavaScript", "language", ("js", "ecmascript")), Skill("TypeScript", "language", ("ts",)),
    Skill("Go", "language", ("golang",), ("Go",)), Skill("Rust", "language"), Skill("C++", "language", ("cpp",)),
    Skill("C#", "language", ("csharp",)), Skill("Ruby", "language"), Skill("PHP", "language"), Skill("Swift", "language"),
    Skill("Objective-C", "language"), Skill("SQL", "language"), Skill("Bash", "language", ("shell scripting",)),
    Skill("Spring", "framework", ("spring boot", "spring framework")), Skill("React", "framework", ("react.js", "reactjs")),
    Skill("React Native", "framework"), Skill("Angular", "framework"), Skill("Vue", "framework", ("vue.js", "vuejs")),
    Skill("Next.js", "framework", ("nextjs",)), Skill("Node.js", "framework", ("nodejs", "node")), Skill("Django", "framework"),
    Skill("Flask", "framework"), Skill("FastAPI", "framework"), Skill("Rails", "framework", ("ruby on rails",)),
    Skill(".NET", "framework", ("dotnet", "asp.net")), Skill("GraphQL", "framework"), Skill("gRPC", "framework"),
    Skill("REST", "framework", ("restful", "rest api", "rest apis")),
    Skill("PostgreSQL", "data", ("postgres",)), Skill("MySQL", "data"), Skill("MongoDB", "data", ("mongo",)), Skill("Redis", "data"),
    Skill("Elasticsearch", "data", ("opensearch",)), Skill("Kafka", "data", ("apache kafka",)), Skill("Spark", "data", ("apache spark", "pyspark")),
    Skill("Snowflake", "data"), Skill("BigQuery", "data"), Skill("Airflow", "data", ("apache airflow",)), Skill("dbt", "data"), Skill("Pandas", "data"),
    Skill("Docker", "infrastructure", ("containers", "containerization")), Skill("Kubernetes", "infrastructure", ("k8s",)),
    Skill("Terraform", "infrastructure"), Skill("AWS", "infrastructure", ("amazon web services",)),
    Skill("GCP", "infrastructure", ("google cloud", "google cloud platform")), Skill("Azure", "infrastructure", ("microsoft azure",)),
    Skill("Linux", "infrastructure"), Skill("CI/CD", "infrastructure", ("continuous integration", "github actions", "jenkins")),
    Skill("Git", "infrastructure", ("github",)), Skill("Microservices", "infrastructure", ("microservice", "distributed systems")),
    Skill("Machine Learning", "ml", ("ml",)), Skill("PyTorch", "ml"), Skill("TensorFlow", "ml"),
    Skill("LLMs", "ml", ("llm", "large language models", "large language model")),
    Skill("Testing", "practice", ("unit testing", "junit", "pytest", "test automation", "tdd")), Skill("Agile", "practice", ("scrum",)),
]

# The example ranking profile.
PROFILE = Profile(
    "generalist-swe",
    ("Python", "Java", "TypeScript", "JavaScript", "React", "Spring", "Node.js", "SQL", "PostgreSQL", "Docker", "Kubernetes",
     "AWS", "Git", "REST", "Linux", "CI/CD", "Testing"),
    ("software engineer", "software developer", "backend", "back end", "full stack", "fullstack", "frontend",
     "front end", "platform engineer", "developer"),
    ("director", "vice president", "vp", "head of", "principal", "distinguished", "intern", "internship"),
)


@dataclass
class SkillDictionary:
    """Skills with the phrases that name them; a skill's own name counts, in any case, unless it has exact spellings."""

    skills: list[Skill] = field(default_factory=lambda: list(SKILLS))

    def __post_init__(self):
        self._by_name: dict[str, Skill] = {}
        self.phrases: list[tuple[int, str, bool]] = []
        for i, s in enumerate(self.skills):
            if s.name.lower() in self._by_name:
                raise ValueError(f"duplicate skill: {s.name}")
            self._by_name[s.name.lower()] = s
            loose = dict.fromkeys([*([] if s.exact else [s.name]), *s.aliases])
            for exact, names in ((False, loose), (True, s.exact)):
                for name in names:
                    if own := phrase_tokens(name, exact):
                        self.phrases.append((i, " ".join(own), exact))

    def canonical(self, name: str) -> str | None:
        s = self._by_name.get(name.lower())
        return s.name if s else None

    def category(self, name: str) -> str | None:
        s = self._by_name.get(name.lower())
        return s.category if s else None

    def frame(self, spark: SparkSession) -> DataFrame:
        """skill, category, position: one row for each skill."""
        return spark.createDataFrame([(s.name, s.category, i) for i, s in enumerate(self.skills)], "skill string, category string, position int")

    def validated(self, profile: Profile) -> Profile:
        """The profile, if the dictionary has all its skills."""
        if missing := [s for s in profile.skills if not self.canonical(s)]:
            raise ValueError(f"skills of the profile that the dictionary doesn't have: {missing}")
        return profile


def load_profile(path: str = "profile.json") -> Profile:
    """A profile from a JSON file with name, skills, title_keywords and title_exclusions; the example if there is none."""
    if not Path(path).exists():
        return PROFILE
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    return Profile(raw.get("name") or "default", *(tuple(raw.get(k) or ()) for k in ("skills", "title_keywords", "title_exclusions")))


def load_boards(path: str) -> list[Board]:
    """Boards from a JSON file: a list of objects with name, ats and token, in the order that boards are crawled."""
    return [Board(x.get("name") or "", x["ats"], x["token"]) for x in json.loads(Path(path).read_text(encoding="utf-8"))]


def boards_frame(spark: SparkSession, boards: list[Board]) -> DataFrame:
    return spark.createDataFrame([(b.name, b.ats, b.token, i) for i, b in enumerate(boards)], "company string, ats string, board_token string, cfg_pos int")


def resolve_boards(requested: list[str] | None, boards: list[Board]) -> list[Board]:
    """Boards by token (of every source that has it) or SOURCE:token (in any case), in the order of the request, each
    once; none requested means all. Unknown names are an error."""
    if not requested:
        return list(boards)
    out: dict[Board, None] = {}
    for name in requested:
        found = [b for b in boards if b.token == name or f"{b.ats}:{b.token}".lower() == name.lower()]
        if not found:
            raise ValueError(f"unknown board: {name}")
        out |= dict.fromkeys(found)
    return list(out)
