"""Substring dedup by sliding sentence spans, in DataFrame functions alone.

A text is cut, without loss, into sentences that end in a terminator or a line end. From every sentence on, the shortest
run of at least `span` (2) consecutive sentences with at least `min_words` (20) words is hashed, sentences stripped of
outer white space; a single sentence of that many words is a run as well. So short phrases that many texts share by
chance don't count, and a passage counts wherever it starts. Runs are counted over the whole corpus with
pre-aggregation; the first occurrence, by (doc_id, position), is the original. Sentences that any later occurrence of a
repeated run covers are removed.

A run is known by two 64-bit hashes of its sentences' hashes. Rows are known by hashes of doc_id and text, so rows that
repeat both are one document and get equal results. Defined results: null and empty texts stay as they are; texts with
fewer words than a run are unchanged, copies of each other or not; a run has `min_words` sentences at most, so where
sentences without words stand between it may not exist; rows without doc_id come first; other columns are carried along,
but for those named `n_sentences` or `n_removed`, whose names the results take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import numbered, written

SPAN = 2
MIN_WORDS = 20
#: Fixed value: what ends a sentence.
ENDS = ".!?\n。！？।؟"
#: Sentences, each with its terminators; concatenated they are the text.
SENTENCE = f"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+"
#: One of ENDS, as a class that a letter fails in two steps: the bits of the ASCII ends, and the range of the others.
_END = "[" + "".join(c for c in ENDS if c < "\x80") + "[\u0600-\uffff&&[" + "".join(c for c in ENDS if c >= "\x80") + "]]]"
#: Fixed value: what is stripped from sentences before they are hashed, and stands between words.
BLANKS = " \t\n\x0b\f\r"


def _sentences(text: str):
    """The matches of SENTENCE, cut after each run of ends, as that takes a fifth of the time of matching them."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), f"(?<={_END})(?!{_END})"), "")


def _runs(span: int, min_words: int):
    """Of the columns h (hashes of sentences) and w (their words): structs of at (first sentence, from 0), n (sentences),
    r0 and r1 (the run's hashes)."""

    def one(at, n):
        return F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"), *[F.xxhash64(F.lit(salt), F.slice("h", at + 1, n)).alias(f"r{salt}") for salt in (0, 1)])

    def size(at):
        # Counts sentences until there are enough words and sentences; the sum stays as it is from then on.
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
        enough = lambda a: (a["n"] >= span) & (a["words"] >= min_words)
        total = F.aggregate(F.slice("w", at + 1, max(span, min_words)), start, lambda a, x: F.when(enough(a), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["words"] + x).alias("words"))))
        return F.transform(F.array(total), lambda a: F.when(enough(a), a["n"]).otherwise(0))[0]

    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    long = F.transform(F.filter(places, lambda i: F.get("w", i) >= min_words), lambda i: one(i, F.lit(1)))
    sized = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), size(i).alias("n"))), lambda p: p["n"] > 0)
    return F.concat(F.transform(sized, lambda p: one(p["i"], p["n"])), long)


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """Later occurrences of repeated runs: a (row hash of the key), t (of the text), at (first sentence, from 0), n (sentences)."""
    ident = [F.col(key).cast("long").alias("k"), F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(text).alias("t")]
    stripped = F.transform(_sentences(text), lambda s: F.btrim(s, F.lit(BLANKS)))
    counted = F.transform(stripped, lambda s: F.struct(F.xxhash64(s).alias("h"), F.regexp_count(s, F.lit(f"[^{BLANKS}]+")).alias("w")))
    # Written, as both the count and the join need it, and texts are read and cut once.
    hashed = written(docs.select(*ident, counted.alias("s")).select("k", "a", "t", F.col("s.h").alias("h"), F.col("s.w").alias("w")))
    runs = hashed.select("k", "a", "t", F.explode(_runs(span, min_words)).alias("r")).select("k", "a", "t", "r.*")
    place = F.struct("k", "a", "t", "at", "n")
    # Written, so that the join reads runs straight from their exchange: only then can a run that is very common be
    # split over tasks as a skewed join.
    first = written(runs.groupBy("r0", "r1").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("r0", "r1", "first"))
    return runs.join(first, ["r0", "r1"]).where(place != F.col("first")).select("a", "t", "at", "n")


def remove_repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs with the text changed, and n_sentences, n_removed (sentences)."""
    if span < 1 or min_words < 0:
        raise ValueError("a run has one sentence at least")
    plain, at = numbered(docs)
    key, text = at[key], at[text]
    hits = repeated_runs(plain, text, key, span, min_words).groupBy("a", "t").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    keyed = plain.withColumns({"a": F.xxhash64(F.lit(1), key), "t": F.xxhash64(text)})
    joined = keyed.join(hits, ["a", "t"], "left").withColumn("s", _sentences(text))
    places = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    gone = F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    with_kept = joined.withColumn("kept", F.when(F.col("hits").isNotNull(), F.array_except(places, gone)))
    changed = F.when(F.col("hits").isNull(), F.col(text)).otherwise(F.array_join(F.transform("kept", lambda i: F.get("s", i)), ""))
    columns = [(changed if at[c] == text else F.col(at[c])).alias(c) for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    return with_kept.select(*columns, F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.size("s") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"))
