"""Language identification of mixed-language text.

Every word gets a score for each language; the script of its letters narrows the candidates; Viterbi decoding over the
words with a switching penalty labels spans, and the language with most letters names the document.

A model is a table of hashed letter-trigram log-probabilities, one column for each language. It is fitted on a sample of
labelled rows whose size is bounded by a parameter; its own size depends on the number of buckets and languages alone.

Letters are those of Unicode's category L, on all planes; marks belong to the letter that they follow and are none by
themselves. The words of a text are decoded one after the other, so a single very long text keeps one task busy for a
time in proportion to its length.

Defined results: a null, empty or letterless text is `und` with score 0 and no spans; a text in a script that no
language was learned with falls back to all languages, ties going to the first in alphabetical order; with nothing
learned every text is `und`. Rows are independent, so repeated rows get equal results, and other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, mixed

UNKNOWN = "und"
BUCKETS = 1 << 15
SAMPLE_PER_LANG = 4000
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.02

#: The first code points of runs of one script, 0 for letters of all other scripts.
SCRIPTS = [
    (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0),
    (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 10), (0x0C80, 0), (0x0E00, 11), (0x0E80, 0),
    (0x10A0, 12), (0x1100, 13), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0),
    (0x3400, 15), (0xA000, 0), (0xAC00, 13), (0xD7B0, 0), (0xF900, 15), (0xFB00, 0), (0x20000, 15), (0x32400, 0),
]
N_SCRIPTS = 16


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower-case form if it is a letter, itself if it is a mark, else 0; if it is a mark; its script."""
    lower, mark = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        s = chr(c)
        kind = unicodedata.category(s)[0]
        if kind == "L":
            t = s.lower()
            lower[c] = ord(t) if len(t) == 1 else c
        elif kind == "M":
            lower[c], mark[c] = c, True
    script = np.zeros(0x110000, np.uint8)
    for (first, kind), (end, _) in zip(SCRIPTS, [*SCRIPTS[1:], (0x110000, 0)]):
        script[first:end] = kind
    return lower, mark, script


def _features(data: np.ndarray, at: np.ndarray):
    """Of one block: trigram buckets of each letter, word starts among the letters, script and text of each word,
    and the words' start and end as code points of their texts."""
    lower, mark, script = _letters()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = (data & 0xC0) != 0x80
    char_at = np.concatenate(([0], np.cumsum(begins)))[at]
    low = lower[points]
    marks = np.flatnonzero(mark[points])
    if len(marks):  # those that follow no letter, or another text's, are no part of a word
        base = np.where(mark[points], -1, np.arange(len(points)))
        base = np.maximum.accumulate(base)[marks]
        first = char_at[np.searchsorted(char_at, marks, "right") - 1]
        low[marks[(base < first) | (low[np.maximum(base, 0)] == 0)]] = 0
    letters = np.flatnonzero(low)
    if not len(letters):
        return None
    doc = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(letters, char_at)))
    new = np.ones(len(letters), bool)
    new[1:] = (np.diff(letters) > 1) | (np.diff(doc) > 0)
    first = np.flatnonzero(new)
    code = low[letters].astype(np.uint64)
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:] = np.where(new[1:], 0, code[:-1])
    after[:-1] = np.where(new[1:], 0, code[1:])
    with np.errstate(over="ignore"):
        bucket = (mixed((before << np.uint64(42)) | (code << np.uint64(21)) | after) % np.uint64(BUCKETS)).astype(np.int64)
    last = np.append(first[1:], len(letters)) - 1
    base = char_at[doc[first]]
    return bucket, first, script[points[letters[first]]], doc[first], letters[first] - base, letters[last] + 1 - base


@dataclass
class LanguageModel:
    """langs in alphabetical order; scores[bucket, lang]; allowed[script, lang]."""

    langs: list[str]
    scores: np.ndarray
    allowed: np.ndarray

    def spans(self, data: np.ndarray, at: np.ndarray, penalty: float = SWITCH_PENALTY):
        """Per word: text, start, end, chosen language; per text: letters of each language."""
        n_docs, n_langs = len(at) - 1, len(self.langs)
        total = np.zeros((n_docs, n_langs))
        found = _features(data, at) if n_langs and len(data) else None
        if found is None:
            return None, total
        bucket, first, script, doc, start, end = found
        emit = np.add.reduceat(self.scores[bucket], first, axis=0)
        emit -= emit.max(axis=1, keepdims=True)
        can = self.allowed[script]
        emit[~can] = -1e4
        path = _viterbi(emit, doc, n_docs, penalty)
        np.add.at(total, (doc, path), end - start)
        return (doc, start, end, path), total


def _viterbi(emit: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Best state of each word; the texts advance together, longest first, so that each step is one array operation."""
    n_langs = emit.shape[1]
    sizes = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
    heads = begin[order]
    stay = np.zeros((len(emit), n_langs), bool)
    best = np.zeros(len(emit), np.int32)
    now = emit[heads].copy()
    best[heads] = now.argmax(axis=1)
    for step in range(1, len(active)):
        k = active[step]
        top = now[:k].max(axis=1, keepdims=True) - penalty
        at = heads[:k] + step
        keep = now[:k] >= top
        stay[at] = keep
        now[:k] = np.where(keep, now[:k], top) + emit[at]
        best[at] = now[:k].argmax(axis=1)
    path = np.zeros(len(emit), np.int64)
    state = np.zeros(len(order), np.int64)
    for step in range(len(active) - 1, -1, -1):
        k = active[step]
        at = heads[:k] + step
        ends = sizes[order[:k]] == step + 1
        if step + 1 < len(active):
            nxt = active[step + 1]
            follow = at[:nxt]
            held = stay[follow + 1, state[:nxt]]
            state[:nxt] = np.where(held, state[:nxt], best[follow])
        state[:k][ends] = best[at[ends]]
        path[at] = state[:k]
    return path


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Learn from about `per_lang` rows of each language at most (rows with a language and a text), chosen by a hash of the key."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in docs.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.create_map(*[F.lit(x) for s in langs for x in (s, min(1.0, per_lang / counts[s]))])
    spread = (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("l")]
    place = {s: i for i, s in enumerate(langs)}

    def count(batches):
        table: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.column("l").to_pylist()
            for a, b, data, at in blocks(batch.column("t")):
                found = _features(data, at) if len(data) else None
                if found is None:
                    continue
                bucket, first, script, doc, start, end = found
                size = np.diff(np.append(first, len(bucket)))
                of_doc = np.array([place.get(s, -1) for s in names[a:b]])
                of_letter = np.repeat(of_doc[doc], size)
                for i in np.unique(of_letter[of_letter >= 0]):
                    own = table.setdefault(int(i), np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    own[:BUCKETS] += np.bincount(bucket[of_letter == i], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(script[of_doc[doc] == i], weights=size[of_doc[doc] == i], minlength=N_SCRIPTS).astype(np.int64)
        for i, own in table.items():
            used = np.flatnonzero(own)
            yield pa.record_batch([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["i", "b", "n"])

    sums = docs.where(spread).select("t", "l").mapInArrow(count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n"))
    rows = sums.toPandas()
    table = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    table[rows["b"].to_numpy(), rows["i"].to_numpy()] = rows["n"].to_numpy()
    grams = table[:BUCKETS] + 0.1
    scripts = table[BUCKETS:] / np.maximum(table[BUCKETS:].sum(axis=0), 1)
    allowed = scripts >= SCRIPT_SHARE
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Per row: the key, lang_pred, score (share of the letters in spans of that language) and spans, which are
    (start, end, lang) in code points, from the first letter of a span to its last."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def label(batches):
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            for a, b, data, at in blocks(batch.column(1)):
                found, total = m.spans(data, at, penalty)
                n = b - a
                letters = total.sum(axis=1)
                pick = np.where(letters > 0, total.argmax(axis=1) if m.langs else 0, len(m.langs))
                score = (total.max(axis=1) if m.langs else np.zeros(n)) / np.maximum(letters, 1)
                if found is None:
                    offsets, flat = np.zeros(n + 1, np.int32), pa.array([], span_type.value_type)
                else:
                    doc, start, end, path = found
                    new = np.ones(len(doc), bool)
                    new[1:] = (np.diff(doc) > 0) | (np.diff(path) != 0)
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(doc)) - 1
                    flat = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(end[last]), pa.array(names[path[first]], pa.string())], fields=list(span_type.value_type))
                    offsets = np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(a, n), pa.array(names[pick], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), flat, type=span_type)],
                    names=[key, "lang_pred", "score", "spans"],
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(label, f"`{key}` {kind}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
