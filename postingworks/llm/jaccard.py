"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more link.

Texts with equal sets become one class. Candidates come from two routes, and each is checked on the whole sets:
SimHash's Gray-order forest over fingerprints of the same shingles, which is cheap but misses pairs, and prefix
filtering, which misses none. Of two linked sets both hold a common shingle among their first n - ceil(0.8 n) + 1, in
any order that is the same for all. The order is by how full a shingle's counter is in a table of fixed size, filled
from all classes, so that common passages come last; the table sets the cost only, never the result.

All pairs of a large group are never made at first: each class is compared with the smallest one of each prefix shingle
that it has, then, twice, with one of a few random ones that share the shingle and are of another component; at last only
pairs from different components remain. Of these go, inside the join that makes them, all whose sketches differ in more
bits than similar sets differ in shingles: a sketch has a bit for each value of some bits of the shingles' hashes, and
each bit that two sketches don't share stands for a shingle at least that the sets don't share.

Defined results: ASCII case and white space don't count; texts with fewer words than a shingle are one shingle of all
their words; null, empty and blank texts are one class; rows without a key are left out; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, even_hashes, mixed, written
from .components import components
from .simhash import link_classes, shingle_hashes, voted

SHINGLE = 5
SIMILARITY = 0.8
#: Counters of the table that orders shingles, and counters of a row in which they are added up.
COUNTERS = 1 << 20
RANGE = 1 << 12
#: Longs of a sketch of 1,024 bits, and their columns.
WORDS = 16
SKETCH = [f"s{i}" for i in range(WORDS)]
#: Random stars before the rest is compared, and classes of each star, about.
ROUNDS = 2
STAR = 8
#: Keeps ceil() and >= right where a product of the similarity isn't an exact double.
_EPS = 1e-9


#: Texts of which the shingles are sorted at once: number of the text and top bits of the hash share 64 bits.
_TEXT_BITS = 14


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE):
    """By runs of texts: first text, one past the last, distinct shingles of each text, ascending, as hashes of 50 bits,
    the text of each, and whole hashes of all shingles, repeats included, with their number in each text."""
    for a, b, h, n in shingle_hashes(texts, shingle, even_hashes):
        begin = np.concatenate(([0], np.cumsum(n)))
        found, owner = [], []
        for first in range(0, b - a, 1 << _TEXT_BITS):
            sizes = n[first : first + (1 << _TEXT_BITS)]
            key = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(64 - _TEXT_BITS) | h[begin[first] : begin[first] + sizes.sum()] >> np.uint64(_TEXT_BITS)
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
            found.append(key & np.uint64((1 << 64 - _TEXT_BITS) - 1))
            owner.append((key >> np.uint64(64 - _TEXT_BITS)).astype(np.int64) + first)
        yield a, b, np.concatenate(found), np.concatenate(owner), (h, n)


def _sketches(h: np.ndarray, doc: np.ndarray, texts: int) -> list[np.ndarray]:
    """Of each text a bitmap over the top 10 bits of its shingles' hashes, as columns of longs."""
    out = np.empty((texts, WORDS), np.int64)
    for a in range(0, texts, 4096):
        low, high = np.searchsorted(doc, (a, a + 4096))
        bits = np.zeros((min(4096, texts - a), 64 * WORDS), bool)
        bits[doc[low:high] - a, (h[low:high] >> np.uint64(64 - _TEXT_BITS - 10)).astype(np.int64)] = True
        out[a : a + 4096] = np.packbits(bits, axis=1).view(np.int64)
    return [np.ascontiguousarray(out[:, i]) for i in range(WORDS)]


def class_rows(docs: DataFrame, text: str, key: str, shingle: int = SHINGLE) -> DataFrame:
    """Per row the key, t (hash of the text), c (hash of the set), fp (fingerprint) and s0 ... (the set's sketch)."""
    kind = docs.schema[key].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            for a, b, h, doc, every in shingle_sets(batch.column(2), shingle):
                with np.errstate(over="ignore"):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(1)))))
                    c = np.diff(total[np.searchsorted(doc, np.arange(b - a + 1))])
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(c.view(np.int64)), pa.array(voted(*every).view(np.int64)), *map(pa.array, _sketches(h, doc, b - a))], names=[key, "t", "c", "fp", *SKETCH])

    return docs.select(F.col(key), F.xxhash64(text).alias("t"), F.col(text)).mapInArrow(hashed, f"`{key}` {kind}, t long, c long, fp long" + "".join(f", {s} long" for s in SKETCH))


def fill(texts: DataFrame, shingle: int = SHINGLE, counters: int = COUNTERS) -> np.ndarray:
    """The table of counters over all classes (c, x). Tasks add up ranges of counters, of which a row has one, as the
    counters of a task would be as large as its texts if each had a row."""
    width = min(counters, RANGE)

    def rows(table: np.ndarray):
        at = np.flatnonzero(table.any(axis=1))
        return pa.record_batch([pa.array(at.astype(np.int64)), pa.array([table[i].tobytes() for i in at], pa.binary())], names=["r", "n"])

    def counted(batches):
        table = np.zeros(counters, np.uint32)
        for batch in batches:
            for _, _, h, _, _ in shingle_sets(batch.column(0), shingle):
                table += np.bincount((h & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)
        yield rows(table.reshape(-1, width))

    def added(batches):
        table = np.zeros((counters // width, width), np.uint64)
        for batch in batches:
            for r, n in zip(batch.column(0).to_numpy(), batch.column(1)):
                table[r] += np.frombuffer(n.as_buffer(), np.uint32)
        yield rows(np.minimum(table, 0xFFFFFFFF).astype(np.uint32))

    filled = texts.select("x").mapInArrow(counted, "r long, n binary").repartition("r").mapInArrow(added, "r long, n binary").toArrow()
    table = np.zeros((counters // width, width), np.uint32)
    for r, n in zip(filled["r"].to_pylist(), filled["n"].to_pylist()):
        table[r] = np.frombuffer(n, np.uint32)
    return table.ravel()


def prefixes(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, counters: int = COUNTERS) -> DataFrame:
    """Classes (c, x: a text) to rows (h, c, n, p): the shingles of each set's prefix, the set's size, the place from 0."""
    table = fill(texts, shingle, counters)

    def first(batches):
        for batch in batches:
            for a, b, h, doc, _ in shingle_sets(batch.column(1), shingle):
                n = np.bincount(doc, minlength=b - a)
                # By text and counter; equal ones stay in the order of their hashes.
                order = np.argsort(doc << 32 | table[h & np.uint64(counters - 1)], kind="stable")
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                long = n - np.ceil(similarity * n - _EPS).astype(np.int64) + 1
                keep = place < long[doc]
                doc = doc[keep]
                c = batch.column(0).slice(a, b - a).to_numpy()[doc]
                yield pa.record_batch([pa.array(h[order][keep].view(np.int64)), pa.array(c), pa.array(n[doc].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=["h", "c", "n", "p"])

    return texts.select("c", "x").mapInArrow(first, "h long, c long, n int, p int")


def _may_link(n, p, m, q, similarity: float):
    """If sets of n and m shingles whose first common one has places p and q can be similar enough."""
    return F.least(n - p, m - q) >= (n + m) * (similarity / (1 + similarity)) - _EPS


def linked(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the distinct pairs (u, v) of classes whose sets are similar enough."""

    def compared(batches):
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = []
                for column in (2, 3):
                    found = list(shingle_sets(part.column(column), shingle))
                    sets.append(np.concatenate([(doc + first).astype(np.uint64) << np.uint64(64 - _TEXT_BITS) | h for first, _, h, doc, _ in found]))
                total = sum(np.bincount((x >> np.uint64(64 - _TEXT_BITS)).astype(np.int64), minlength=len(part)) for x in sets)
                common = np.bincount((np.intersect1d(*sets, assume_unique=True) >> np.uint64(64 - _TEXT_BITS)).astype(np.int64), minlength=len(part))
                union = total - common
                yield pa.record_batch(part.columns[:2], names=["u", "v"]).filter(pa.array(common >= similarity * union - _EPS))

    with_u = pairs.join(texts.select(F.col("c").alias("u"), F.col("x").alias("xu")), "u")
    both = with_u.join(texts.select(F.col("c").alias("v"), F.col("x").alias("xv")), "v")
    return both.select("u", "v", "xu", "xv").mapInArrow(compared, "u long, v long")


def _labelled(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of prefix shingles that classes share, with k, the component of the row's class."""
    found = written(components(edges))
    return shared.join(found, shared["c"] == found["node"], "left").select("h", "c", "n", "p", "m", F.col("low.c").alias("low"), F.coalesce("component", "c").alias("k"))


def _random_star(labelled: DataFrame, salt: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of classes with the smallest one of a few, dealt by a hash, that share a prefix shingle with them."""
    dealt = labelled.withColumn("b", F.pmod(F.xxhash64("c", "h", F.lit(salt)), F.greatest(F.lit(1).cast("long"), F.floor(F.col("m") / STAR))))
    centre = dealt.groupBy("h", "b").agg(F.min(F.struct("c", "n", "p", "k")).alias("x"))
    met = dealt.join(centre, ["h", "b"]).where((F.col("k") != F.col("x.k")) & _may_link(F.col("n"), F.col("p"), F.col("x.n"), F.col("x.p"), similarity))
    return met.select(F.least("c", "x.c").alias("u"), F.greatest("c", "x.c").alias("v")).distinct()


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row that has a key: the key, t (hash of the text), and `component`, equal for rows that links connect."""
    docs = docs.where(F.col(key).isNotNull())
    rows = written(class_rows(docs, text, key, shingle))
    classes = written(rows.groupBy("c").agg(F.min(F.struct(key, "t")).alias("r"), F.min("fp").alias("fp"), *[F.min(s).alias(s) for s in SKETCH]))
    chosen = classes.select("c", F.col(f"r.{key}").alias("k"), F.col("r.t").alias("t"))
    held = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    texts = written(held.join(chosen, ["k", "t"]).select("c", "x").dropDuplicates(["c"]))
    place = F.struct("c", "n", "p")
    same = Window.partitionBy("h")
    prefix = prefixes(texts, shingle, similarity)
    shared = written(prefix.withColumns({"low": F.min(place).over(same), "high": F.max("c").over(same), "m": F.count("*").over(same)}).where("low.c <> high").drop("high"))
    star = shared.where((F.col("c") != F.col("low.c")) & _may_link(F.col("n"), F.col("p"), F.col("low.n"), F.col("low.p"), similarity)).select(F.col("low.c").alias("u"), F.col("c").alias("v"))
    # Fingerprints aren't distinct here, so the classes of an equal one are a star as well.
    least = written(classes.groupBy("fp").agg(F.min("c").alias("id")))
    equal = classes.join(least, "fp").where("c <> id").select(F.col("id").alias("u"), F.col("c").alias("v"))
    near = link_classes(least).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    edges = written(linked(written(star.union(equal).union(near).distinct()), texts, shingle, similarity))
    for salt in range(ROUNDS):
        labelled = written(_labelled(shared, edges))
        edges = written(edges.union(linked(written(_random_star(labelled, salt, similarity)), texts, shingle, similarity)))
        discard(labelled)
    labelled = written(_labelled(shared, edges))
    discard(shared)
    several = written(labelled.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("h"))
    left = written(labelled.join(several, "h", "left_semi").where("c <> low").drop("m").join(classes.select("c", *SKETCH), "c"))
    other = left.select("h", F.col("c").alias("v"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("k").alias("l"), *[F.col(s).alias(f"o{s}") for s in SKETCH])
    differ = reduce(add, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"o{s}"))) for s in SKETCH])
    near_enough = differ <= (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + _EPS
    rest = left.join(other, "h").where((F.col("c") < F.col("v")) & (F.col("k") != F.col("l")) & _may_link(F.col("n"), F.col("p"), F.col("m"), F.col("q"), similarity) & near_enough)
    more = linked(written(rest.select(F.col("c").alias("u"), "v").distinct()), texts, shingle, similarity)
    final = written(components(edges.union(more)))
    return rows.join(final, rows["c"] == final["node"], "left").select(key, "t", F.coalesce("component", "c").alias("component"))
