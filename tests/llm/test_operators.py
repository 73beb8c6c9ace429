"""Each operator against brute force on a small awkward table: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from postingworks.llm import bpe, chat, gbt, langid, packing, queries, rules, simhash, spans, suffix, topk
from postingworks.llm.components import components

SCHEMA = "doc_id long, text string, lang string, score double, fp string, kept string"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(80), prose(6000)
    out = [None, "", " \n\t", "!!!", "one", "one two", "A b\tC  d", "aaaa " * 120, "x" * 1500, passage, passage + " end", prose(30) + passage + prose(30), long, long[:9000] + "Z" + long[9000:]]
    out += [prose(60) + ".\n" + prose(20) for _ in range(12)]
    return out + [out[-1], out[-2], out[-2]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 1.0, "x", "y") for i, t in enumerate(texts())]
    rows += [(None, "no id here", "fr", None, None, None), (3, "!!!", "en", 0.0, "x", "z")]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify_languages(none, langid.fit_languages(none)).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert suffix.remove_repeated_passages(none.select("doc_id", "text")).count() == 0
    assert packing.pack_documents(none, queries.PIECES_FILE).count() == 0
    assert rules.apply_rules(none, rules.log_ratios(none, none)).count() == 0
    assert gbt.score_documents(none, gbt.fit_classifier(none, none.withColumn("quality", F.lit(1)))).count() == 0
    assert bpe.encode_texts(none, queries.WORDS_FILE).count() == 0 and spans.remove_repeated_spans(none).count() == 0


def test_language_id(spark, docs):
    rows = [(i, t, l, 1.0, "", "") for i, (t, l) in enumerate([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), ("кот и собака " * 9, "ru")] * 4)]
    model = langid.fit_languages(spark.createDataFrame(rows, SCHEMA))
    mixed = [(1, "the cat and the dog the cat und der hund und die katze und die katze", None, 1.0, "", ""), (2, "кот", None, 1.0, "", ""), (3, None, None, 1.0, "", ""), (4, "12 !!", None, 1.0, "", "")]
    got = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(mixed, SCHEMA), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and 0 < got[1].score < 1
    assert got[2].lang_pred == "ru" and got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0
    assert langid.identify_languages(docs, model).count() == docs.count()


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 0, 5]
    emit = rng.normal(size=(sum(sizes), 3)) * 3
    doc = np.repeat(np.arange(4), sizes)
    path = langid._viterbi(emit, doc, 4, 2.0)
    for d in range(4):
        e = emit[doc == d]
        value = lambda p: sum(e[i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        if len(e):
            best = max(value(p) for p in itertools.product(range(3), repeat=len(e)))
            assert abs(value(list(path[doc == d])) - best) < 1e-9


def _fingerprint(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints():
    own = texts()
    assert simhash.fingerprints(pa.array(own)).tolist() == [_fingerprint(t) for t in own]


def test_near_duplicates(docs):
    rows = [r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None]
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    near = {i: {i} for i in fps}
    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            near[a].add(b), near[b].add(a)
    low = {i: i for i in fps}
    for _ in fps:
        low = {i: min(low[j] for j in near[i]) for i in fps}
    assert all(r.component_id == low[r.doc_id] for r in rows) and len(rows) == docs.where("doc_id is not null").count()


def test_gray_trees_and_divided_shards(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 5))) for b in base for _ in range(25)})
    x = np.array(fps, np.uint64)
    order = np.argsort(simhash.gray_rank(x))
    x = x[order]
    got = {tuple(p) for i, j in simhash.GrayTree(np.zeros(len(x), np.int64), x).links(3, 1 << 10) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= 3}
    assert got == want
    classes = spark.createDataFrame([(int(f) - (1 << 64 if f >= 1 << 63 else 0), i) for i, f in enumerate(x.tolist())], "fp long, id long")
    found = [{(r.node, r.component) for r in components(simhash.link_classes(classes, shard_rows=n)).collect()} for n in (20_000, 5)]
    assert found[0] == found[1]


def test_span_dedup(spark):
    rows = [(2, "B one. C two. D three. E own."), (1, "A. B one. C two.  D three."), (3, None), (4, ""), (5, "B one. C two."), (6, "x. x. x. x.")]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[1][1], 0), 2: (" E own.", 3), 3: (None, 0), 4: ("", 0), 5: (rows[4][1], 0), 6: ("", 4) if got[6][1] == 4 else ("x.", 3)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, small, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name], small)


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.PIECES_FILE)
    rows = packing.pack_documents(docs, queries.PIECES_FILE).toPandas().sort_values(["doc_id", "piece"])
    by_text = {i: t for i, t in enumerate(texts())}
    for i, g in rows[rows.doc_id != 3].dropna(subset=["doc_id"]).groupby("doc_id"):
        ids = [*plain.encode(by_text[i] or "", add_special_tokens=False).ids, 2]
        assert [x for p in g.ids for x in p] == ids and all(g.length.iloc[1:] == 1024) and list(g.start) == list(np.cumsum(g.length) - g.length)
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(g.ids, g.ids_crc32))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 1024


def test_plan_equals_one_by_one():
    rng = random.Random(9)
    lengths = [rng.randrange(1, 41) for _ in range(500)]
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= x]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= x
        else:
            bins.append(40 - x)
    plan = packing.best_fit_plan(dict(Counter(lengths)), 40)
    used = Counter()
    total = Counter(lengths)
    for k, (length, rank, each, first, offset) in enumerate(plan):
        end = next((p[1] for p in plan[k + 1 :] if p[0] == length), total[length])
        for t in range(end - rank):
            used[first + t // each] += length
    assert sorted(40 - n for n in used.values()) == sorted(bins)


def test_byte_encoder_special_strings():
    from tokenizers import Tokenizer

    t = "a <|endoftext|> b\n\n  c'll 12é"
    assert packing.ByteEncoder(queries.PIECES_FILE)(t) == Tokenizer.from_file(queries.PIECES_FILE).encode(t, add_special_tokens=False).ids


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [None, 1.0, 1.0, 1.0]), (62, [float("nan")] * 4), (63, [1.0, 2.0]), (None, [1.0] * 4)]
    rows += [(64, rows[7][1]), (64, rows[7][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    ints = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows if i is not None and i not in (60, 61, 62, 63)}
    for q in range(0, 60, 10):
        want = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_chat(spark):
    rows = [(1, 0, "user", "a & <| &lt;| <|im_end|>\n"), (1, 1, "assistant", "r&amp;1"), (1, 2, None, None), (1, 3, "assistant", "x\ny"), (1, 4, "us\ner", "tail"), (2, 0, "user", "only"), (None, None, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_conversations(turns).collect()
    assert len(examples) == 5 and all(e.text[e.loss_start : e.loss_end].count("<|") == 0 for e in examples)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)) and got[1].n_turns == 5
    assert got[1].loss_sha256 == sha("r&amp;1x\ny") and got[1].loss_chars == 10 and got[2].loss_chars == 0 and got[2].n_turns == 1


def test_rules(docs):
    got = {r.doc_id: r for r in rules.apply_rules(docs.where("doc_id is not null"), np.zeros(rules.BUCKETS)).collect()}
    for i, t in enumerate(texts()):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed, not failed)


def test_classifier_separates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = gbt.fit_trees(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert gbt.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_bpe(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.WORDS_FILE)
    c = bpe.codec(queries.WORDS_FILE)
    odd = ["Hé  <|endoftext|>wo'S  ÉÀ 1234 <|STARTOFTEXT|> İß x <|startoftext|>\n é ²½ ① ΑΣ Σ", "é \x85　\x1c a", "b" * 700, "日本語 😀 don't"]
    for t in [*odd, *(t or "" for t in texts())]:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids and c.decode(ids) == plain.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(docs, queries.WORDS_FILE).count() == docs.count()


@pytest.mark.parametrize("keep, parts", [("none", 20_000), ("first", 20_000), ("none", 2)])
def test_passages(docs, keep, parts):
    own = {i: (t or "").encode() for i, t in enumerate(texts())}
    where = {}
    for i, b in sorted(own.items()):
        for p in range(len(b) - 199):
            where.setdefault(b[p : p + 200], []).append((i, p))
    table = docs.where("doc_id is not null and not (doc_id = 3 and score = 0)").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in suffix.remove_repeated_passages(table, keep=keep, group_rows=parts).collect()}
    for i, b in own.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            at = where[b[p : p + 200]]
            if len(at) > 1 if keep == "none" else at[0] != (i, p):
                gone[p : p + 200] = b"\1" * 200
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone) if not g)
        assert sum(s.end - s.start for s in got[i].removed) == sum(gone)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}
