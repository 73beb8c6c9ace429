"""Every stage of the pipeline against a plain Python version over a small corpus, and the whole run on the driver's tables."""

import importlib.util
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from postingworks.llm import gbt, packing, queries, rules


def _sibling(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


models, near = (_sibling(n) for n in ("test_models", "test_near_copies"))


def _corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdeéiou") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + (". " if k % 9 == 8 else "") for k in range(n))
    junk = lambda n: " ".join("".join(rng.choice("#*$%&|<>XQZ019") for _ in range(4)) for _ in range(n))
    passage = prose(70)
    texts = [None, "", " \n", "short text", "same words " * 60, "x" * 3000]
    texts += [prose(rng.randrange(55, 160)) for _ in range(50)]
    texts += [junk(80) for _ in range(15)] + [prose(30) + junk(40) for _ in range(8)]
    texts += [prose(40) + passage + prose(rng.randrange(5, 40)) for _ in range(6)]
    base = prose(150).split(" ")
    texts += [" ".join(base), re.sub("[a-z]+", lambda m: m[0].upper(), " ".join(base)), " ".join([*base[:70], "other", *base[71:]]), " ".join(base[:120])]
    texts += [texts[10], texts[11] + " end", texts[12]]
    docs = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not re.search(r"[#$%|]", t or "#")), 0) for i, t in enumerate(texts) if i % 3] + [(9999, 1, 0)]
    return docs, labels


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = _corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, labels, folder


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def _plain_rules(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    raw, target = Counter(), Counter()
    for i, t, *_ in docs:
        raw.update(grams := models._trigrams(t))
        if i in good:
            target.update(grams)
    share = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * rules.BUCKETS)
    ratio = {b: math.log(share(target, b)) - math.log(share(raw, b)) for b in raw}
    kept = []
    for row in docs:
        words = [w for w in re.split("[\x20\x09-\x0d]+", row[1] or "") if w]
        tri = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in range(3)}
        grams = models._trigrams(row[1])
        if len(words) >= 50 and 2 * len(covered) <= len(words) and sum(ratio[b] for b in grams) / max(1, len(grams)) >= rules.THRESHOLD:
            kept.append(row)
    return kept


def test_quality_rules(spark, corpus):
    docs, labels, folder = corpus
    want = _plain_rules(docs, labels)
    assert _rows(corpus_pipeline.quality_rules(spark, spark.createDataFrame(docs, COLUMNS), folder)) == sorted(want)
    assert 20 < len(want) < len([d for d in docs if len((d[1] or "").split()) >= 50])  # the ratio rejects some as well


def test_quality_classifier(spark, corpus):
    docs, labels, folder = corpus
    model = gbt.fit_classifier(spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def score(text):
        x = models._features(text)
        row = [x[f] for f in gbt.FEATURES]
        total = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return 1 / (1 + math.exp(-total))

    want = [d for d in docs if score(d[1]) >= 0.7]
    assert _rows(corpus_pipeline.quality_classifier(spark, spark.createDataFrame(docs, COLUMNS), folder)) == sorted(want, key=lambda d: d[0])
    assert 20 < len(want) < len(docs) - 20


def test_near_dedup(spark, corpus):
    docs, _, folder = corpus
    groups = near._groups([d[1] for d in docs])
    want = [d for d, g in zip(docs, groups) if d[0] == g]
    assert _rows(corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(docs, COLUMNS), folder)) == sorted(want, key=lambda d: d[0])
    assert len(want) <= len(docs) - 6


def _whole_characters(raw, kept_flags):
    """Runs of removed bytes shrink to whole characters."""
    out, i = bytearray(), 0
    while i < len(raw):
        j = i
        while j < len(raw) and kept_flags[j] == kept_flags[i]:
            j += 1
        if kept_flags[i]:
            out += raw[i:j]
        else:
            s, e = i, j
            while s < len(raw) and raw[s] & 0xC0 == 0x80:
                s += 1
            while 0 < e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            out += raw[i:s] + raw[max(s, e) : j] if s < e else raw[i:j]
        i = j
    return bytes(out)


def test_suffix_array_dedup(spark, corpus):
    docs, _, folder = corpus
    first = defaultdict(list)
    for i, t, *_ in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - 199):
            first[raw[p : p + 200]].append((i, p))
    want = []
    for i, t, lang, source, n in docs:
        raw = (t or "").encode()
        keep = [True] * len(raw)
        for p in range(len(raw) - 199):
            if first[raw[p : p + 200]][0] != (i, p):
                keep[p : p + 200] = [False] * 200
        left = _whole_characters(raw, keep).decode()
        if all(keep):
            want.append((i, t, lang, source, n))
        elif left:
            want.append((i, left, lang, source, len(left)))
    assert _rows(corpus_pipeline.suffix_array_dedup(spark, spark.createDataFrame(docs, COLUMNS), folder)) == sorted(want, key=lambda d: d[0])
    assert len(want) < len(docs) and sum(a != b for a, b in zip(want, [d for d in docs if d[0] in {w[0] for w in want}])) >= 5


def test_best_fit_packing(spark, corpus):
    from tokenizers import Tokenizer

    docs, _, folder = corpus
    plain = Tokenizer.from_file(queries.PIECES_FILE)
    rows = corpus_pipeline.best_fit_packing(spark, spark.createDataFrame(docs, COLUMNS), folder).toPandas().sort_values(["doc_id", "piece"])
    lengths = []
    for i, t, *_ in docs:
        own = rows[rows.doc_id == i]
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for p in own.ids for x in p] == ids
        lengths += list(own.length)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 1024
    bins = []  # best fit decreasing, one piece after the other
    for x in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= x]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= x
        else:
            bins.append(packing.CAPACITY - x)
    assert rows.sequence_id.nunique() == len(bins)


def test_run_is_its_stages(spark, corpus):
    docs, _, folder = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [df.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = _rows(stage(spark, df, folder))
        assert {r[0] for r in kept} <= {r[0] for r in _rows(df)}
        df = spark.createDataFrame(kept, COLUMNS)
        seen.append(len(kept))
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < seen[0]
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r[0] for r in kept}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run_on_the_driver_s_tables(spark, small):
    packed = corpus_pipeline.run(spark, small)
    assert packed.count() > 100 and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
