"""Quality rules: base counts of words, symbols and repeats, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte trigrams (boundary bytes included): the trusted target, counted
over all rows labelled as good, and the raw corpus, counted over every row. A document's score is its
sum of log ratios over its number of trigrams; a fixed threshold decides. Nothing about a document depends on others
but through the two tables of counts, so equal texts get equal verdicts.

Defined results: a null, empty or blank text has no words and fails the base rules; if no trusted rows are known every
score is 0 and the base rules decide; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, mixed, range_hashes, words

BUCKETS = 1 << 16
THRESHOLD = -0.6
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per text of one block: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and word hashes for others."""
    n = len(at) - 1
    starts, ends, of_doc = words(data, at)
    counts = np.diff(of_doc)
    doc = np.repeat(np.arange(n), counts)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])

    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    word_hash = range_hashes(data, starts, ends)
    repeat = _repeat_words(word_hash, doc, n)
    return {
        "n_words": counts, "word_chars": per_doc(inside & ((data & 0xC0) != 0x80)), "n_symbols": per_doc(table[data]),
        "n_dup_lines": _dup_lines(data, at, starts), "n_repeat_words": repeat, "word_hash": word_hash, "word_doc": doc, "starts": starts, "ends": ends,
    }


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.append(False, s[1:] == s[:-1])
    again = np.zeros(len(keys), bool)
    again[order] = same
    more = same.copy()
    more[:-1] |= same[1:]
    out = np.zeros(len(keys), bool)
    out[order] = more
    return out, again


def _repeat_words(word_hash: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    if len(doc) < 3:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        h = mixed(mixed(word_hash[:-2] + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + mixed(word_hash[1:-1] + np.uint64(1)) * np.uint64(5) + word_hash[2:])
    valid = np.flatnonzero(doc[:-2] == doc[2:])
    twice = np.zeros(len(doc), bool)
    twice[valid] = _repeated(h[valid])[0]
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return np.bincount(doc[covered], minlength=n)


def _dup_lines(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(at) - 1
    cuts = np.flatnonzero(data == 10)
    begin = np.concatenate((at[:-1], cuts + 1))
    end = np.concatenate((cuts, at[1:]))
    order = np.lexsort((np.concatenate((np.full(n, -1), np.zeros(len(cuts), np.int64))), begin))
    begin = begin[order]
    # The k-th line of a text ends at its k-th cut or at its end.
    end = np.sort(end, kind="stable")
    doc = np.minimum(np.searchsorted(at, begin, "right") - 1, n - 1)
    ok = end > begin
    begin, end, doc = begin[ok], end[ok], doc[ok]
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    with np.errstate(over="ignore"):
        key = mixed(range_hashes(data, begin, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bincount(doc[_repeated(key)[1]], minlength=n) if len(doc) else np.zeros(n, np.int64)


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte, flags of those that lie within one text, and their number per text."""
    n = len(data)
    x = data.astype(np.uint32)
    code = np.zeros(n, np.uint32)
    if n >= 3:
        code[:-2] = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
    valid = np.ones(n, bool)
    tails = at[1:]
    for k in (1, 2):
        cut = tails - k
        valid[cut[cut >= at[:-1]]] = False
    return bucket, valid, np.maximum(np.diff(at) - 2, 0)


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """log(target / raw) of each bucket. trusted: keys of good rows, all of which are counted; the raw counts cover all rows."""
    # One plan at all sizes: each text is written to the shuffle once, and only keys are held, never sorted texts.
    good_keys = trusted.select(F.col(key).cast("long").alias("k"), F.lit(True).alias("g")).where("k is not null").distinct().hint("shuffle_hash")

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            known = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, at in blocks(batch.column(1)):
                bucket, valid, _ = _grams(data, at)
                raw += np.bincount(bucket[valid], minlength=BUCKETS)
                valid &= np.repeat(known[a:b], np.diff(at))
                good += np.bincount(bucket[valid], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(good[used])], names=["b", "raw", "good"])

    marked = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(good_keys, "k", "left").select(F.coalesce("g", F.lit(False)).alias("g"), "t")
    sums = marked.mapInArrow(count, "b int, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    rows = sums.toPandas()  # of bounded size: a row for each bucket
    raw, good = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    raw[rows["b"]] += rows["raw"]
    good[rows["b"]] += rows["good"]
    if not rows["good"].sum():
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def _verdicts(texts: pa.Array, weight: np.ndarray, threshold: float):
    """For each block of texts: first row, row after the last, base counts, base_failed, llr, kept."""
    for a, b, data, at in blocks(texts):
        base = base_counts(data, at)
        bucket, valid, n = _grams(data, at)
        sums = np.concatenate(([0.0], np.cumsum(np.where(valid, weight[bucket], 0.0))))
        llr = np.diff(sums[at]) / np.maximum(n, 1)
        failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
        yield a, b, base, failed, llr, ~failed & (llr >= threshold)


def apply_rules(docs: DataFrame, ratios: np.ndarray, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the key, the base counts, base_failed, llr (mean log ratio a trigram), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches):
        for batch in batches:
            for a, b, base, failed, llr, kept in _verdicts(batch.column(1), shared.value, threshold):
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(base[x].astype(np.int64)) for x in names), pa.array(failed), pa.array(llr), pa.array(kept)], names=[key, *names, "base_failed", "llr", "kept"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(judge, f"`{key}` {kind}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, llr double, kept boolean")


def kept_documents(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    place = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            for a, b, _, _, _, kept in _verdicts(batch.column(place), shared.value, threshold):
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
