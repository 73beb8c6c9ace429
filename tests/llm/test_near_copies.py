"""The pipeline's near-dedup against brute force over all pairs."""

import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from postingworks.llm import jaccard
from postingworks.llm.common import CLEANUP, written


def _shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _groups(texts):
    """Smallest index reachable through pairs of similarity 0.8, for each text."""
    sets = [_shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if (a == b or 10 * len(a & b) >= 8 * len(a | b)) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def _texts():
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(400)]
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i"]
    shared = " ".join(rng.choices(vocabulary, k=30))
    for size in (12, 30, 60, 120, 250):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            out.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 4, 8):
                copy = list(base)
                for at in rng.sample(range(size), min(edits, size)):
                    copy[at] = rng.choice(vocabulary)
                out.append(" ".join(copy).upper() if edits == 1 else " ".join(copy))
            out.append(f"{shared} {' '.join(rng.choices(vocabulary, k=6))}")
    # A chain whose ends alone are not similar.
    base = rng.choices(vocabulary, k=100)
    out += [" ".join(base[i : i + 80]) for i in range(0, 20, 5)]
    return out


def test_near_copies_are_those_of_brute_force(spark):
    texts = _texts()
    want = _groups(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = jaccard.near_copies(docs).collect()
    least = {}
    for r in rows:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.component] for r in rows} == dict(enumerate(want))
    assert 20 < len(set(want)) < len(texts) - 40


def test_stage_keeps_the_first_of_each_group_and_rows_without_id(spark, tmp_path):
    texts = _texts()
    want = _groups(texts)
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[-1], "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want))
    assert [r.text for r in kept if r.doc_id is None] == [texts[-1]]


def test_other_texts_under_one_doc_id_stay(spark, tmp_path):
    words = [" ".join(f"{name}{i}" for i in range(40)) for name in "abc"]
    # Document 2 has a copy of document 1 and a text of its own.
    rows = [(1, words[0], "en", "web", 1), (2, words[1], "en", "web", 2), (2, words[0], "en", "web", 1), (2, words[1], "en", "other", 2), (2, words[2], "en", "web", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        kept = corpus_pipeline.simhash_near_dedup(spark, docs.repartition(parts), str(tmp_path)).collect()
        assert sorted(map(tuple, kept)) == [rows[0], rows[3], rows[4]]


def test_counters_are_filled_from_all_classes(spark):
    rows = [(i, f"common words of every text here {i} {i * 7} end") for i in range(-40, 40)]
    want = np.zeros(1 << 6, np.int64)
    for _, _, h, _, _ in jaccard.shingle_sets(pa.array([x for _, x in rows])):
        np.add.at(want, (h & np.uint64((1 << 6) - 1)).astype(np.int64), 1)
    assert jaccard.fill(spark.createDataFrame(rows, "c long, x string").repartition(3), counters=1 << 6).tolist() == want.tolist()


def test_shuffles_end_with_what_is_written(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(CLEANUP, None)
    made = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while files() - before and time.time() < end:  # they are removed in the background
        time.sleep(0.1)
    assert not files() - before and made.count() == 7 and spark.conf.get(CLEANUP, None) == setting
