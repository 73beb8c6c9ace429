"""Job titles: normal form, tokens, level words, signatures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip, strings, words

# Abbreviations and what they stand for, level words, words that say nothing about a job.
ABBREVIATIONS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "eng": "engineer", "engr": "engineer",
    "swe": "software engineer", "sde": "software engineer", "mgr": "manager", "mgmt": "management",
    "dev": "developer", "ops": "operations", "ii": "2", "iii": "3", "iv": "4",
}
LEVELS = [
    "intern", "internship", "junior", "associate", "mid", "senior", "staff", "principal", "lead",
    "distinguished", "head", "director", "vp", "chief", "1", "2", "3", "4", "5",
]
STOP_WORDS = [
    "and", "or", "of", "the", "for", "a", "an", "in", "at", "to", "with", "on",
    "de", "la", "le", "les", "des", "du", "en", "et", "nb",
]
# What no title word holds, and requisition numbers.
NOT_TITLE = r"[^\p{L}\p{N}+#]+"
REQUISITION = r"^[a-z]{1,3}\d{4,}$"


def normalize(title: Column) -> Column:
    """Lower case, letters, digits, + and # only, requisition ids dropped, abbreviations written out; null gives ''."""
    flat = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), NOT_TITLE, " ")
    kept = F.filter(words(flat), lambda w: ~w.rlike(REQUISITION))
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def tokens_of(normal: Column) -> Column:
    """Distinct words of a normalized title, in order."""
    return F.array_distinct(words(normal))


def tokens(title: Column) -> Column:
    return tokens_of(normalize(title))


def levels(tokens: Column) -> Column:
    return F.array_intersect(tokens, strings(LEVELS))


def stem(word: Column) -> Column:
    n = F.length(word)
    plural = (n > 3) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us")
    return F.when((n > 5) & word.endswith("ing"), F.left(word, n - 3)).when(plural, F.left(word, n - 1)).otherwise(word)


def signature(tokens: Column) -> Column:
    """Stems of the tokens that are neither stop words nor single letters, distinct, in order."""
    stop = strings(STOP_WORDS)
    kept = F.filter(tokens, lambda w: ~F.array_contains(stop, w) & ~w.rlike(r"^\p{L}$"))
    return F.array_distinct(F.transform(kept, stem))


def contains_phrase(normal: Column, phrases: list[str], normal_phrases: list[str] | None = None) -> Column:
    """Whether a whole-word phrase stands in a normalized title; phrases must be normalized, empty ones never match."""
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    found = F.lit(False)
    for p in phrases:
        if p:
            found = found | padded.contains(f" {p} ")
    return found


def normalize_text(title: str | None) -> str:
    """The same normal form for a driver-side string, such as a phrase of a profile."""
    import regex

    flat = regex.sub(NOT_TITLE, " ", (title or "").lower())
    return " ".join(ABBREVIATIONS.get(w, w) for w in flat.split(" ") if w and not regex.fullmatch(r"[a-z]{1,3}[0-9]{4,}", w))


__all__ = ["normalize", "normalize_text", "tokens", "tokens_of", "levels", "stem", "signature", "contains_phrase", "strip"]
