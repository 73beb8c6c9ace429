"""SimHash near-duplicates through Gray-order hierarchical indexes.

A fingerprint has 64 bits; two link if at most `radius` (3) bits differ. Equal fingerprints become one class first, so
copies cost nothing further. The 64 bits form five segments; of two fingerprints that differ in three bits two segments
at least are equal, so every class goes, under each of the ten pairs of segments, to the shard with its values there.
A shard that is too large is divided further by its other bits (four parts, one of which must be equal again). Each
shard sorts its fingerprints by Gray rank and builds a tree over runs of them: a node holds the bits that all below it
share and that its ancestors don't have already, so a search adds up differences from the top and drops whole groups
once the sum passes the radius. A shard returns a spanning forest of its links, never all pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts with fewer words than
a shingle use their whole word sequence; repeated rows share class and component; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import blocks, words, written
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Rows of a shard from which it is divided by further bits.
SHARD_ROWS = 20_000
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
FAN = 16


def seeded_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 with the operator's seed of each byte range."""
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(raw[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist())], np.uint64)


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE, hashes=seeded_hashes):
    """By runs of texts: first text, one past the last, hashes of all shingles in order, number of each text's shingles."""
    for a, b, data, at in blocks(texts):
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, of_doc = words(data, at)
        if not len(starts):
            yield a, b, np.zeros(0, np.uint64), np.zeros(b - a, np.int64)
            continue
        # One space after each word but the last of its text, and no other white space: a shingle is a byte range.
        keep = np.zeros(len(data) + 1, bool)
        keep[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        counts = np.diff(of_doc)
        final = np.zeros(len(starts), bool)
        final[of_doc[1:][counts > 0] - 1] = True
        gaps = ends[~final]
        keep[gaps] = True
        data[gaps] = 32
        place = np.cumsum(keep) - keep
        n = np.maximum(np.minimum(counts, 1), counts - shingle + 1)
        first = np.repeat(of_doc[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        last = np.minimum(first + shingle, np.repeat(of_doc[1:], n)) - 1
        yield a, b, hashes(data[keep[:-1]], place[starts[first]], place[ends[last] - 1] + 1), n


def voted(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of texts with n shingles each; zero for those without."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' XXH64, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    for a, b, h, n in shingle_hashes(texts, shingle):
        out[a:b] = voted(h, n)
    return out


def fingerprint_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Per row the key and `fp`, the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(fingerprints(batch.column(1), shingle).view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(hashed, f"`{key}` {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each uint64 in the Gray code's order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayTree:
    """Hierarchical indexes of many shards at once; shard: ids in ascending order, fps: uint64 in Gray order in each."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray, fan: int = FAN):
        self.fps = fps
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        first, last, own = np.arange(len(fps)), np.arange(len(fps)), shard
        pattern, mask = fps, np.full(len(fps), full)
        #: From the items upwards: (patterns, bits not held above, first child, one past the last, last item).
        self.levels = []
        kids = (first, first)
        while True:
            step = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(step, len(own)))
            if not len(own) or (sizes.max() == 1 and len(self.levels)):
                self.levels.append((pattern, mask, *kids, last))
                break
            within = np.arange(len(own)) - np.repeat(step, sizes)
            head = np.flatnonzero(within % fan == 0)
            tail = np.append(head[1:], len(own))
            up_and, up_or = np.bitwise_and.reduceat(pattern, head), np.bitwise_or.reduceat(pattern, head)
            shared = np.bitwise_and.reduceat(mask, head) & ~(up_and ^ up_or)
            self.levels.append((pattern, mask & ~np.repeat(shared, tail - head), *kids, last))
            pattern, mask, own, last, kids = up_and & shared, shared, own[head], last[tail - 1], (head, tail)
        self.shard_of_root = own
        self.root = np.repeat(np.arange(len(own)), np.bincount(np.searchsorted(own, shard), minlength=len(own))) if len(own) else np.zeros(0, np.int64)

    def links(self, radius: int = RADIUS, at_once: int = 1 << 20):
        """Yields arrays (i, j), i < j, of all items of one shard at most `radius` bits apart, in parts."""
        n, a = len(self.fps), 0
        chunk = at_once // 64
        while a < n:
            b = min(n, a + chunk)
            stack = [(len(self.levels) - 1, np.arange(a, b), self.root[a:b], np.zeros(b - a, np.int64), True)]
            while stack:
                level, q, node, acc, fresh = stack.pop()
                pattern, mask, begin, end, last = self.levels[level]
                if fresh:
                    acc = acc + np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node])
                    ok = (acc <= radius) & (last[node] > q)
                    q, node, acc = q[ok], node[ok], acc[ok]
                if not len(q):
                    continue
                if level == 0:
                    yield q, node
                    continue
                count = end[node] - begin[node]
                if count.sum() > at_once and len(q) > 1:  # halves, so that memory stays bounded
                    half = len(q) // 2
                    stack += [(level, q[half:], node[half:], acc[half:], False), (level, q[:half], node[:half], acc[:half], False)]
                    continue
                begin = begin[node]
                child = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
                stack.append((level - 1, np.repeat(q, count), child, np.repeat(acc, count), True))
            a = b


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the sets of i and j in place; roots are the smallest members and every entry points at its root."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(shard: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, id of its set's first member) that connect whatever links within the shards."""
    order = np.lexsort((gray_rank(fps), shard))
    shard, fps, ids = shard[order], fps[order], ids[order]
    root = np.arange(len(fps))
    for i, j in GrayTree(shard, fps).links(radius):
        _merge(root, i, j)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return ids[moved], ids[root[moved]]


def _bits(column, first: int, n: int):
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << n) - 1))


def _routes(classes: DataFrame) -> DataFrame:
    """Each class under the ten pairs of segments."""
    keys = [F.struct(F.lit(k).cast("long").alias("part"), F.shiftleft(_bits(F.col("fp"), *SEGMENTS[a]), 13).bitwiseOR(_bits(F.col("fp"), *SEGMENTS[b])).alias("value")) for k, (a, b) in enumerate(combinations(range(5), 2))]
    return classes.select("fp", "id", F.explode(F.array(*keys)).alias("r")).select("fp", "id", (F.shiftleft("r.part", 26).bitwiseOR(F.col("r.value"))).alias("key"), F.lit(0).cast("long").alias("sub"))


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of large shards under each quarter of the bits that their key doesn't fix."""
    out = []
    for k, (a, b) in enumerate(combinations(range(5), 2)):
        free = [i for s, (first, n) in enumerate(SEGMENTS) if s not in (a, b) for i in range(first, first + n)]
        parts = [free[i * len(free) // 4 : (i + 1) * len(free) // 4] for i in range(4)]
        masks = [sum(1 << i for i in p) for p in parts]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        out.append(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)]))
    pick = F.element_at(F.array(*out), (F.shiftrightunsigned("key", 26) + 1).cast("int"))
    return rows.select("fp", "id", "key", F.explode(pick).alias("sub"))


def link_classes(classes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Classes (fp long, distinct; id long) to edges (u, v) that connect all ids whose fingerprints link."""
    if radius > 3:
        raise ValueError("the routing by pairs of segments finds links of up to three bits")
    routes = _routes(classes)
    large = routes.groupBy("key").count().where(F.col("count") > shard_rows).select("key", F.lit(True).alias("large"))
    marked = routes.join(large, "key", "left")
    rows = marked.where("large is null").select("fp", "id", "key", "sub").union(_divided(marked.where("large")))

    def search(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def close(table: pa.Table):
            key, sub = table["key"].to_numpy(), table["sub"].to_numpy()
            new = np.append(True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))
            u, v = forest(np.cumsum(new), table["fp"].to_numpy().view(np.uint64), table["id"].to_numpy(), radius)
            return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < 100_000:
                continue
            table = pa.Table.from_batches(held)
            key, sub = table["key"].to_numpy(), table["sub"].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            if len(new):  # whole shards only
                yield close(table.slice(0, new[-1]))
                held = table.slice(new[-1]).combine_chunks().to_batches()
                size = sum(map(len, held))
        if size:
            yield close(pa.Table.from_batches(held))

    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row: the key (a long), fingerprint (16 hex digits), class_id (smallest key with that fingerprint) and
    component_id (smallest key reachable through links). Rows without a key are returned with null class and component."""
    rows = written(fingerprint_rows(docs, text, key, shingle))
    classes = written(rows.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("id")))
    found = written(components(link_classes(classes, radius, shard_rows)))
    labels = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(labels, "fp", "left")
    has = F.col(key).isNotNull()
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(has, F.col("class_id")).alias("class_id"), F.when(has, F.col("component_id")).alias("component_id"))
