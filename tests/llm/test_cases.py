"""Awkward tables for the operators whose main tests are elsewhere: clashing names, repeated rows, very long texts, hot
groups, empty tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postingworks.llm import chat, queries, simhash, spans, suffix, topk
from postingworks.llm.common import discard, scratch, shared_dir, written


# Sentence spans


def _without_spans(docs, span=spans.SPAN, min_words=spans.MIN_WORDS):
    """(key, text) in order of keys to the texts left and the number of sentences removed."""
    import re

    cut = [(k, re.findall(spans.SENTENCE, t or "")) for k, t in docs]
    seen, gone = set(), defaultdict(set)
    for d, (_, p) in enumerate(cut):
        bare = [s.strip(spans.BLANKS) for s in p]
        size = [len(s.split()) for s in bare]
        for i in range(len(p)):
            runs = [1] if size[i] >= min_words else []
            runs += [n for n in range(span, min(min_words, len(p) - i) + 1) if sum(size[i : i + n]) >= min_words][:1]
            for n in runs:
                run = tuple(bare[i : i + n])
                if run in seen:
                    gone[d] |= set(range(i, i + n))
                seen.add(run)
    return {k: ("".join(s for i, s in enumerate(p) if i not in gone[d]), len(gone[d])) for d, (k, p) in enumerate(cut)}


def test_spans_equal_brute_force(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) for _ in range(n))
    passage = [say(rng.choice([1, 3, 9, 15, 24])) + rng.choice([".", "!", "?", "\n", "。"]) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n \n")]
    for k in range(4, 40):
        own = [say(rng.choice([1, 2, 8, 21])) + ". " for _ in range(6)]
        at = rng.randrange(28)
        rows.append((k, " ".join(own[:3]) + say(2) + " " + " ".join(passage[at : at + rng.randrange(1, 6)]) + " ".join(own[3:])))
    rows += [(40, rows[5][1]), (41, "word. " * 3000), (42, " ".join(f"Sentence number {i} of a long text." for i in range(4000))), (43, " ".join(f"Sentence number {i} of a long text." for i in range(3990)))]
    want = _without_spans(rows)
    # Columns that clash with the operator's own names, and with each other's internal ones.
    docs = spark.createDataFrame([(k, t, k + 1, "s", "h", 1) for k, t in rows], "doc_id long, text string, N_removed long, s string, hits string, c0 int")
    got = spans.remove_repeated_spans(docs)
    assert got.columns == ["doc_id", "text", "s", "hits", "c0", "n_sentences", "n_removed"]
    for r in got.collect():
        assert ((r.text or ""), r.n_removed) == want[r.doc_id], r.doc_id
        assert (r.s, r.hits, r.c0) == ("s", "h", 1)
    assert sum(n > 0 for _, n in want.values()) > 15


def test_spans_of_repeated_rows_and_rows_without_id(spark):
    text = "one two three four five six seven eight nine ten. " * 2
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in spans.remove_repeated_spans(docs).collect())
    # The row without an id is the first; equal rows are one document.
    assert got == [(0, text, 0), (0, "other", 0), (1, " ", 2), (1, " ", 2)]


# Passages


def _covered(rows, keep, length=200):
    """(order, bytes) to which bytes go."""
    where = defaultdict(list)
    for k, b in rows:
        for p in range(len(b) - length + 1):
            where[b[p : p + length]].append((k, p))
    out = {}
    for k, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            at = where[b[p : p + length]]
            if len(at) > 1 if keep == "none" else min(at) != (k, p):
                gone[p : p + length] = b"\1" * length
        out[k] = bytes(x for x, g in zip(b, gone) if not g)
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("parts", [20_000, 3])
def test_many_contexts_of_one_passage(spark, keep, parts):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh \x00é") for _ in range(n))
    passage, other = noise(420), noise(230)
    texts = []
    for i in range(40):
        a, b = rng.randrange(0, 200), rng.randrange(210, 421)
        texts.append(noise(rng.randrange(0, 300)) + passage[a:b] + noise(rng.randrange(0, 300)))
    texts += [other, noise(5) + other, other + noise(5), "ab" * 400, "x" * 199, "x" * 200, noise(100_000) + other]
    # A text that repeats itself at once, and one that differs in the middle of every string.
    texts += [passage[:210] * 3, passage[:100] + "!" + passage[101:300]]
    rows = [(i, t, "k", 1, "x", "y", "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Kept string, _k int, _t string, _runs string, removed string").repartition(3)
    got = suffix.remove_repeated_passages(docs, keep=keep, group_rows=parts)
    assert got.columns == ["doc_id", "text", "_k", "_t", "_runs", "kept", "removed"]
    want = _covered([(i, t.encode()) for i, t in enumerate(texts)], keep)
    for r in got.collect():
        assert bytes(r.kept) == want[r.doc_id], (r.doc_id, keep)
        assert (r._k, r._t, r._runs, r.text) == (1, "x", "y", texts[r.doc_id])


def test_passages_of_repeated_rows_and_rows_without_id(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdef") for _ in range(n)) for n in (300, 260))
    docs = spark.createDataFrame([(None, a), (5, a), (7, b), (7, b), (8, "c" + b), (9, None), (9, "")], "doc_id long, text string")
    left = lambda keep: sorted(((r.doc_id or 0), len(r.kept)) for r in suffix.remove_repeated_passages(docs, keep=keep).collect())
    assert left("none") == [(0, 0), (5, 0), (7, 0), (7, 0), (8, 1), (9, 0), (9, 0)]
    # The row without an id comes first; equal rows are one document.
    assert left("first") == [(0, 300), (5, 0), (7, 260), (7, 260), (8, 1), (9, 0), (9, 0)]


def test_suffix_order_and_factors_equal_brute_force():
    rng = random.Random(6)
    for size in (1, 2, 3, 40):
        segments, lead = [], []
        gram = bytes(rng.choice(b"ab") for _ in range(8))
        for _ in range(size):
            l, r = rng.randrange(0, 13), rng.randrange(0, 13)
            segments.append(bytes(rng.choice(b"ab\0") for _ in range(l)) + gram + bytes(rng.choice(b"ab\0") for _ in range(r)))
            lead.append(l)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in segments])))
        place = np.array(rng.sample(range(1000, 100_000, 50), size), np.int64)
        early, some = suffix.matched_starts(np.frombuffer(b"".join(segments), np.uint8), offsets, np.array(lead), place, 20, 8)
        for i, s in enumerate(segments):
            for p in range(13):
                if p > min(lead[i], len(s) - 20):
                    assert not early[i, p] and not some[i, p]
                    continue
                d = lead[i] - p
                same = [j for j, t in enumerate(segments) if j != i and lead[j] >= d and t[lead[j] - d : lead[j] - d + 20] == s[p : p + 20]]
                assert some[i, p] == bool(same) and early[i, p] == any(place[j] + lead[j] - d < place[i] + p for j in same)


# Top k


@pytest.mark.parametrize("cell, tree", [(2048, 1 << 16), (8, 5)])
def test_top_k_of_shards_equals_brute_force(spark, cell, tree):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) + (i % 5) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)] + [(2000 + i, [float(i), 1.0]) for i in range(9)] + [(3000, []), (3001, []), (3002, [5.0, 1.0, 2.0]), (30, rows[7][1])]
    docs = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, score string, rank double")
    got = defaultdict(list)
    for r in topk.top_k(docs, F.col("vec_id") % 10 == 0, cell_rows=cell, tree_rows=tree).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows]
    for q in {i for i, _ in ints if i % 10 == 0}:
        scored = sorted((-int(a @ b), i) for j, a in ints if j == q for i, b in ints if i != q and len(a) == len(b))
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in scored[:5]], q


def test_tree_boxes_are_tight_and_hold_their_rows():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(500, 4)) * 3)
    tree = topk.KDTree(v, 16)
    leaves = tree.leaf_of(v)
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert (tree.low[node] == v[rows].min(axis=0)).all() and (tree.high[node] == v[rows].max(axis=0)).all() and (leaves[rows] == node).all()
            assert (len(rows) <= 16) or (tree.low[node] == tree.high[node]).all()
    assert sum(len(r) for r in tree.rows if r is not None) == 500


# Others


def test_empty_tables(spark, small):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(none, F.lit(True)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_chat_of_long_and_repeated_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a" * 200_000, 1), (1, 1, "assistant", "é😀" * 50_000, 2), (1, 1, "assistant", "é😀" * 50_000, 2)], "conv_id long, turn long, role string, text string, example int")
    r = chat.read_back(chat.format_conversations(turns)).first()
    assert (r.n_turns, r.loss_chars) == (3, 200_000)


def test_near_duplicates_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [(i, c) for i, _, c in got] == [(0, None), (2, 2), (4, 2), (4, 4)] and got[0][1] == got[3][1]


def test_tables_go_at_the_end_of_their_scope(spark):
    with scratch():
        with scratch():
            inner = written(spark.range(3))
        outer = written(spark.range(5))
        assert outer.count() == 5
        with pytest.raises(Exception, match="(?i)exist"):
            spark.read.parquet(inner._written_at).count()
    table = written(spark.range(2))
    assert table._written_at.startswith(shared_dir(spark)) and table.count() == 2
    discard(table)


def test_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_sentences_are_cut_not_matched(spark):
    texts = ["", "a", "...a.b", "a\x01b. c", "a。b？c؟ d", "!?", None, "a\n\n b.", "é! ü؟؟ 𝄞. 𝄞", "।", "ab cd\r\n.\n\n e"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", spans._sentences("text").alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: re.findall(spans.SENTENCE, t or "") for i, t in enumerate(texts)}
    assert "regexp_extract_all" not in str(spans._sentences("text"))
