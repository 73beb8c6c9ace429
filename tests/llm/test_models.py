"""The fitted operators against plain Python versions over small texts, and against held-out rows of the driver's tables."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postingworks.llm import gbt, langid, queries, rules
from postingworks.llm.common import blocks, mixed

MEDIUM = "/root/testdata/sf0.01"


def _small_texts(spark, small, n=60):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(n).collect()
    own = [(r.doc_id, r.text, r.lang) for r in rows]
    return own + [(1000, None, "en"), (1001, "", "en"), (1002, "1 2 3 !", "en"), (1003, "́́", "en"), (1004, "𐐀𐐁 𝐀𝐁", "xx"), (1005, "éa ́b", "xx"), (1006, "𠀀𠀁", "zh"), (1007, "中文字", "zh")]


# Languages


def _words(text):
    """(start, letters in lower case) of each word: letters and the marks that follow them."""
    out, fresh = [], True
    for i, c in enumerate(text or ""):
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and not fresh:
            low = c.lower() if kind == "L" and len(c.lower()) == 1 else c
            if fresh:
                out.append((i, []))
            out[-1][1].append(ord(low))
            fresh = False
        else:
            fresh = True
    return out


def _script(c):
    return [kind for first, kind in [(0, 0), *langid.SCRIPTS] if first <= c][-1]


def _buckets(word):
    padded = [0, *word, 0]
    code = [(a << 42 | b << 21 | c) & (1 << 64) - 1 for a, b, c in zip(padded, padded[1:], padded[2:])]
    with np.errstate(over="ignore"):
        return (mixed(np.array(code, np.uint64)) % np.uint64(langid.BUCKETS)).astype(int).tolist()


def _languages(rows):
    """langs, log probability of each bucket, candidates of each script."""
    langs = sorted({l for _, t, l in rows if t is not None and l is not None})
    grams, scripts = {l: Counter() for l in langs}, {l: Counter() for l in langs}
    for _, t, l in rows:
        if t is not None and l is not None:
            for at, w in _words(t):
                grams[l].update(_buckets(w))
                scripts[l][_script(ord(t[at]))] += len(w)
    score = {l: (lambda b, g=grams[l], n=sum(grams[l].values()) + 0.1 * langid.BUCKETS: math.log((g[b] + 0.1) / n)) for l in langs}
    allowed = {s: [l for l in langs if scripts[l][s] >= langid.SCRIPT_SHARE * max(1, sum(scripts[l].values()))] or langs for s in range(langid.N_SCRIPTS)}
    return langs, score, allowed


def _identified(text, langs, score, allowed):
    words = _words(text)
    if not words or not langs:
        return "und", 0.0
    now, back = None, []
    for at, w in words:
        emit = {l: sum(score[l](b) for b in _buckets(w)) for l in langs}
        top = max(emit.values())
        emit = {l: emit[l] - top if l in allowed[_script(ord(text[at]))] else -1e4 for l in langs}
        if now is None:
            now = emit
            continue
        best = max(langs, key=lambda l: now[l])
        step = {l: l if now[l] >= now[best] - langid.SWITCH_PENALTY else best for l in langs}
        now = {l: max(now[l], now[best] - langid.SWITCH_PENALTY) + emit[l] for l in langs}
        back.append(step)
    state = max(langs, key=lambda l: now[l])
    total = Counter({state: len(words[-1][1])})
    for step, (_, w) in zip(reversed(back), reversed(words[:-1])):
        state = step[state]
        total[state] += len(w)
    lang = max(langs, key=lambda l: total[l])
    return lang, total[lang] / sum(total.values())


def test_languages_equal_plain_python(spark, small):
    rows = _small_texts(spark, small)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    langs, score, allowed = _languages(rows)
    assert model.langs == langs
    sample = range(0, langid.BUCKETS, 37)
    assert np.allclose(model.scores[sample], [[score[l](b) for l in langs] for b in sample], atol=1e-4)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs, model).collect()}
    for i, t, _ in rows:
        lang, share = _identified(t, langs, score, allowed)
        assert got[i][0] == lang and abs(got[i][1] - share) < 1e-9, i
    assert [got[i][0] for i in range(1000, 1004)] == ["und"] * 4 and got[1004][0] == got[1005][0] == "xx" and got[1006][0] == "zh"


def test_held_out_languages(spark):
    found = queries.op1_language_id(spark, MEDIUM).where("held_out").join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("lang is not null and length(text) > 100").collect()
    assert len(found) > 150 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


# Quality


def _trigrams(text):
    raw = (text or "").encode()
    return [((int.from_bytes(raw[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 16) & (rules.BUCKETS - 1) for i in range(len(raw) - 2)]


def test_rules_equal_plain_python(spark, small):
    rows = [(i, t) for i, t, _ in _small_texts(spark, small, 120)]
    # A Thue-Morse line and its complement, on which sums of powers modulo 2^64 agree.
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows.append((2000, f"{morse}\n{morse.translate(str.maketrans('ab', 'ba'))}"))
    good = {i for i, _ in rows if i % 3 == 0} | {5000}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = rules.log_ratios(docs, spark.createDataFrame([(i,) for i in [*good, 0, 0]], "doc_id long"))
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(_trigrams(t))
        if i in good:
            target.update(_trigrams(t))
    share = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * rules.BUCKETS)
    want = np.array([math.log(share(target, b)) - math.log(share(raw, b)) for b in range(rules.BUCKETS)])
    assert np.allclose(ratios, want)
    middle = float(np.median([np.mean(want[g]) for _, t in rows if (g := _trigrams(t))]))
    got = {r.doc_id: r for r in rules.apply_rules(docs, ratios, threshold=middle).collect()}
    kept = set()
    for i, t in rows:
        grams, words = _trigrams(t), [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        llr = float(np.sum(want[grams])) / len(grams) if grams else 0.0
        assert abs(got[i].llr - llr) < 1e-9
        tri = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert (got[i].base_failed, got[i].n_repeat_words) == (failed, len(covered))
        if abs(llr - middle) > 1e-9:
            assert got[i].kept == (not failed and llr >= middle), i
        if got[i].kept:
            kept.add(i)
    assert got[2000].n_dup_lines == 0 and 5 < len(kept) < len(rows) - 5
    assert {r.doc_id for r in rules.kept_documents(docs, ratios, threshold=middle).collect()} == kept


def _features(text):
    raw = (text or "").encode()
    if not raw:
        return dict.fromkeys(gbt.FEATURES, 0.0)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    n, size = max(1, len(words)), len(raw)
    share = lambda chars: sum(b in chars for b in raw) / size
    ending = lambda chars: sum(w[-1] in chars for w in words) / n
    chars, lines = sum(len(w.decode()) for w in words), raw.count(b"\n")
    full = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\f\r")]
    tri = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return {
        "log_chars": math.log1p(chars), "log_words": math.log1p(len(words)), "word_length": chars / n, "upper": share(range(65, 91)), "lower": share(range(97, 123)), "digit": share(range(48, 58)),
        "punctuation": share(b".,;:?!'\"()-"), "symbol": share(b"#*$%&|<>^~@_=+\\{}[]"), "space": share(b" \t\n\x0b\f\r"), "line": lines / n, "bang": share(b"!"), "stop": share(b"."), "beyond_ascii": share(range(128, 256)),
        "symbols_a_word": sum(b in b"#*$%&|<>" for b in raw) / n, "dup_lines": (len(full) - len(set(full))) / (lines + 1), "repeat_words": len(covered) / n, "distinct_words": 1 - (len(words) - len(set(words))) / n,
        "same_neighbour": sum(a == b for a, b in zip(words, words[1:])) / n, "ends_in_symbol": ending(b"#*$%&|<>!"), "ends_in_stop": ending(b".,;:?"), "upper_words": sum(len(w) > 1 and 65 <= w[1] <= 90 for w in words) / n,
        "longest_word": max(map(len, words), default=0), "pipe": share(b"|"),
    }


def test_statistics_equal_plain_python(spark, small):
    texts = [t for _, t, _ in _small_texts(spark, small, 150)] + ["A B\nA B\n!! $$ $$ ab| ab|", " \n ", "x"]
    for a, b, data, at in blocks(pa.array(texts), 20_000):
        got = gbt.statistics(data, at)
        for t, row in zip(texts[a:b], got):
            want = _features(t)
            for name, x in zip(gbt.FEATURES, row):
                assert abs(x - want[name]) < 1e-9, (name, t)


def test_flat_trees_equal_recursion():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    model = gbt.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=7)

    def value(node, row):
        if model.feature[node] < 0:
            return model.value[node]
        return value(model.left[node] + (row[model.feature[node]] > model.threshold[node]), row)

    want = [1 / (1 + math.exp(-model.base - sum(value(r, row) for r in model.roots))) for row in x]
    assert np.allclose(model.score(x), want)


def test_the_fit_is_bounded_whatever_keys_repeat(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(500)] + [(None, "none"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, 1), (1, 7)], "doc_id long, quality int")
    seen = []
    fit, gbt.fit_trees = gbt.fit_trees, lambda x, y: seen.append(y) or fit(x, y)
    try:
        model = gbt.fit_classifier(docs, labels, sample_rows=100)
    finally:
        gbt.fit_trees = fit
    assert len(seen[0]) <= 100
    scores = gbt.score_documents(docs, model).collect()
    assert len(scores) == 502 and all(0 <= r.score <= 1 for r in scores)


def _auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for s in np.unique(scores):
        ranks[np.array(scores) == s] = np.mean(np.flatnonzero(np.array(scores)[order] == s)) + 1
    positive = np.array(labels) == 1
    n, m = positive.sum(), (~positive).sum()
    return (ranks[positive].sum() - n * (n + 1) / 2) / (n * m)


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    found = queries.op8_quality_classifier(spark, MEDIUM).where("held_out").join(labels, "doc_id").collect()
    assert len(found) > 40 and _auc([r.score for r in found], [r.quality for r in found]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) for r in found)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


@pytest.mark.parametrize("text, letters", [("𠀀𠀁", 2), ("𝐀", 1), ("́", 0), ("́á", 2), ("- ं", 0), ("कि", 2)])
def test_letters(text, letters):
    raw = text.encode()
    found = langid._features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert (0 if found is None else len(found[0])) == letters
