"""Suffix-array dedup of passages: longest-previous-factor arrays over the whole corpus.

A byte is removed if a string of `length` (200) bytes that covers it also starts elsewhere; matches lie within texts.
The corpus doesn't fit one suffix array, so matches are first brought together by content: of the 151 50-byte grams in a
200-byte string the one with the smallest hash is its anchor, wherever the string stands. So only grams that are anchors
somewhere and occur twice matter, each with the 150 bytes before and 200 bytes after its start: its segment.

Equal segments of one anchor form a class, by pre-aggregation; copies need no further comparison. Where an anchor has
several classes, one representative of each is compared, in tasks of bounded bytes. A task sorts the representatives by
their bytes from the anchor on and takes the common prefix of neighbours from the bytes themselves. The alphabetical
order of the suffixes one byte further left is that order, stably sorted by the byte in front; so the suffix order and
LCP array of all string starts come from 151 counting sorts, those without an equal left part dropping out on the way.
Previous and next smaller places in each order give the longest previous factors.

Anchors with more than `group_rows` classes are divided over tasks by a hash; string starts that find no earlier match in
their own part are then counted over all parts, known by 128-bit hashes of their bytes.

`keep="first"` removes later copies only, in the order of (key, position); `keep="none"` removes all of them.

Defined results: null, empty and short texts are unchanged; rows that repeat both key and text count as copies of each
other for "none" and as one document for "first"; rows without a key come first; other columns are carried along, but
for those named `kept` or `removed`, whose names the results take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import blocks, mixed, numbered, written

LENGTH = 200
GRAM = 50
GROUP_ROWS = 20_000
#: Bytes of segments that a task orders at once, but for larger groups, which have `group_rows` segments about at most.
ARRAY_BYTES = 4 << 20
#: Rows of segments that are taken from a batch, or given back, at once.
CUT_ROWS = 1024
#: Bytes of text in which anchors are looked for at once.
BLOCK = 1 << 19
#: Stands for a missing key: before all others.
NO_KEY = -(1 << 63)

_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _two_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse; kept for blocks of the usual size."""
    size = max(n, BLOCK + 1)
    if size in _powers:
        return _powers[size]
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(x))
    if size == BLOCK + 1:  # not those of a rare, very long text
        _powers[size] = tuple(out)
    return tuple(out)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every `width` bytes, in order of their starts. They choose anchors and group them; that unequal grams
    may share one costs time, never a wrong match."""
    up, down = _two_powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(data)]
        np.cumsum(terms, out=total[1:])
        x = total[width:] - total[: len(data) + 1 - width]
        x *= down[: len(x)]
    return mixed(x)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for every i; x is padded by repeating its last value."""
    n = len(x)
    size = -(-(n + width) // width) * width
    y = np.concatenate((x, np.full(size - n, x[-1], x.dtype))).reshape(-1, width)
    head = op.accumulate(y, axis=1).ravel()
    tail = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[:n], head[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of one block: text, start in it, bytes before and after the start that belong to the segment, hash of the gram."""
    n, width = len(data), length - gram + 1
    sizes = np.diff(at)
    ok = sizes >= length
    if not ok.any():
        return None
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.full(n, top)
    h[: n - gram + 1] = gram_hashes(data, gram)
    low = _sliding(h, width, np.minimum)
    valid = np.zeros(n + 1, np.int8)  # starts of whole strings
    valid[at[:-1][ok]] += 1
    np.subtract.at(valid, (at[1:] - length + 1)[ok], 1)
    low[np.cumsum(valid[:n]) == 0] = 0
    # A gram is an anchor if some valid window around it has it as its minimum: the maximum of their minima.
    back = _sliding(low[::-1].copy(), width, np.maximum)[::-1]
    where = np.flatnonzero((h == back) & (back > 0) & (h < top))
    doc = np.searchsorted(at, where, "right") - 1
    pos = where - at[doc]
    return doc, pos, np.minimum(pos, length - gram), np.minimum(length, sizes[doc] - pos), h[where]


def previous_factors(lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, in suffix order: the common prefix with the nearest suffix before or after
    it in that order whose place in the corpus is smaller. lcp[i] is that of suffixes i - 1 and i (lcp[0] = 0)."""

    def before(lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
        # Minima of places and prefixes over runs of 1, 2, 4, ... suffixes that end at each; then descents from long runs.
        n = len(place)
        tables, size = [(place, lcp)], 1
        longest = int(np.diff(np.flatnonzero(np.append(lcp == 0, True))).max()) if n else 0
        while 2 * size < longest + 1:
            p, c = tables[-1]
            p2, c2 = p.copy(), c.copy()
            p2[size:] = np.minimum(p[size:], p[:-size])
            c2[size:] = np.minimum(c[size:], c[:-size])
            tables.append((p2, c2))
            size *= 2
        at, best = np.arange(n), np.full(n, np.iinfo(np.int64).max)
        for k in range(len(tables) - 1, -1, -1):
            p, c = tables[k]
            step = 1 << k
            # Skip the `step` suffixes before `at` if none is smaller.
            can = at >= step
            can &= p[np.maximum(at - 1, 0)] >= place
            best = np.where(can, np.minimum(best, c[at]), best)
            at = np.where(can, at - step, at)
        best = np.minimum(best, lcp[at])
        found = (at > 0) & (place[np.maximum(at - 1, 0)] < place)
        return np.where(found, best, 0)

    if not len(lcp):
        return np.zeros(0, np.int64)
    ahead = before(lcp, place)
    turned = np.append(lcp[1:], 0)[::-1]
    turned = np.append(0, turned[1:]) if len(turned) else turned
    after = before(turned, place[::-1])[::-1]
    return np.maximum(ahead, after)


class _Tails:
    """Segments in the order of their bytes from the anchor on, and common prefixes of any two of them."""

    def __init__(self, data: np.ndarray, anchor: np.ndarray, right: np.ndarray, length: int):
        padded = np.concatenate((data, np.zeros(length, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, length)[anchor]
        rows[np.arange(length) >= right[:, None]] = 0
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")
        n = len(anchor)
        shared = np.zeros(n, np.int16)
        for a in range(1, n, 1 << 13):  # in parts, so that memory follows the bytes
            b = min(n, a + (1 << 13))
            differ = rows[self.order[a:b]] != rows[self.order[a - 1 : b - 1]]
            shared[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        self.shared = shared
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self._right = right
        self._minima = [shared]  # over runs of 1, 2, 4, ... that end at each
        while 2 << (len(self._minima) - 1) <= n:
            low, size = self._minima[-1].copy(), 1 << (len(self._minima) - 1)
            low[size:] = np.minimum(low[size:], self._minima[-1][:-size])
            self._minima.append(low)
        self._minima = np.stack(self._minima)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common bytes from the anchor on of segments x and y, x before y in the order."""
        a, b = self.rank[x], self.rank[y]
        k = np.frexp((b - a).astype(float))[1] - 1
        low = np.minimum(self._minima[k, b], self._minima[k, a + (1 << k)])
        return np.minimum(low, np.minimum(self._right[x], self._right[y]))


def matched_starts(data: np.ndarray, offsets: np.ndarray, lead: np.ndarray, place: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Segments as bytes and offsets, with the bytes of each before its anchor and the place of its first byte in the
    corpus, to two flags for each segment and start in it: whether an earlier string is equal, whether any other one is."""
    n, reach = len(lead), length - gram
    early, some = np.zeros((n, reach + 1), bool), np.zeros((n, reach + 1), bool)
    if n < 2:
        return early, some
    anchor, right = offsets[:-1] + lead, np.diff(offsets) - lead
    tails = _Tails(data, anchor, right, length)
    # In suffix order: the segments that still have others with the same left part, and where a new left part begins.
    now, head = tails.order, tails.shared < gram
    head[0] = True
    for d in range(reach + 1):
        part = np.cumsum(head) - 1
        alive = np.bincount(part)[part] > 1
        now, head, part = now[alive], head[alive], part[alive]
        if not len(now):
            break
        lcp = np.zeros(len(now), np.int64)
        next_to = np.flatnonzero(~head)
        lcp[next_to] = d + tails.common(now[next_to - 1], now[next_to])
        equal = lcp >= length
        begins = np.flatnonzero(~equal)
        runs = np.diff(np.append(begins, len(now)))
        # Runs of few and of many go apart, so that descents are short for most.
        for few in (True, False):
            wanted = (runs > 1) & ((runs <= 16) == few)
            if not wanted.any():
                continue
            sizes = runs[wanted]
            own = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(begins[wanted] - own, sizes)
            near = lcp[at]
            near[own] = 0
            who = now[at]
            start = lead[who] - d
            some[who, start] = True
            early[who, start] = previous_factors(near, place[who] + start) >= length
        # One byte further left; only those go on that may still reach the length with a neighbour.
        best = np.maximum(lcp, np.append(lcp[1:], 0)) - d
        go = (lead[now] > d) & (best >= length - lead[now])
        now, part = now[go], part[go]
        if not len(now):
            break
        byte = data[anchor[now] - d - 1]
        order = np.argsort(byte, kind="stable")
        now, part, byte = now[order], part[order], byte[order]
        head = np.append(True, (byte[1:] != byte[:-1]) | (part[1:] != part[:-1]))
    return early, some


def _intervals(flags: np.ndarray) -> pa.ListArray:
    """Runs of flagged starts of each segment as lists of (lo, hi)."""
    n = len(flags)
    edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edges == 1)
    hi = np.nonzero(edges == -1)[1] - 1
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], names=["lo", "hi"]))


RUNS = "array<struct<lo: long, hi: long>>"


def _anchor_rows(docs: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """docs (k, t, text) to rows (gram) or, if whole, (gram, seg, k, t, spot); spot packs start << 20 | before << 10 |
    after, and seg is XXH64 of the segment's bytes."""

    def found(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            k, t = (batch.column(i).to_numpy() for i in (0, 1))
            for a, _, data, at in blocks(batch.column(2), BLOCK):
                hit = anchors(data, at, length, gram) if len(data) else None
                if hit is None:
                    continue
                doc, pos, left, right, h = hit
                columns = [h.view(np.int64)]
                if whole:
                    where, raw = at[doc] + pos, data.tobytes()
                    seg = [digest(raw[s:e], x) for s, e, x in zip((where - left).tolist(), (where + right).tolist(), (left << 10 | right).tolist())]
                    columns += [np.array(seg, np.uint64).view(np.int64), k[a + doc], t[a + doc], pos << 20 | left << 10 | right]
                yield pa.record_batch([pa.array(x) for x in columns], names=["gram", "seg", "k", "t", "spot"][: len(columns)])

    return docs.mapInArrow(found, "gram long, seg long, k long, t long, spot long" if whole else "gram long")


def _segments(classes: DataFrame, docs: DataFrame, group_rows: int) -> DataFrame:
    """Classes (gram, seg, k, t, spot of the first, c: classes of the gram) with the bytes of their segments."""
    wanted = classes.groupBy("k", "t").agg(F.collect_list(F.struct("spot", "gram", "seg", "c")).alias("w"))

    def cut(batches):
        last = None
        for batch in batches:
            ks, ts, lists = batch.column("k").to_numpy(), batch.column("t").to_numpy(), batch.column("w")
            fields = {f: lists.values.field(f).to_numpy() for f in ("spot", "gram", "seg", "c")}
            ends = lists.offsets.to_numpy()
            for i, text in enumerate(batch.column("text")):
                if (ks[i], ts[i]) == last:  # a repeated row
                    continue
                last = ks[i], ts[i]
                raw = text.as_py().encode("utf-8")
                for a in range(ends[i], ends[i + 1], CUT_ROWS):
                    spot, gram, seg, c = (fields[f][a : min(a + CUT_ROWS, ends[i + 1])] for f in ("spot", "gram", "seg", "c"))
                    pos, left, right = spot >> 20, spot >> 10 & 1023, spot & 1023
                    pieces = [raw[s:e] for s, e in zip((pos - left).tolist(), (pos + right).tolist())]
                    part = (seg.view(np.uint64) % ((c.astype(np.uint64) + np.uint64(group_rows - 1)) // np.uint64(group_rows))).astype(np.int64)
                    n = len(spot)
                    yield pa.record_batch([pa.array(x) for x in (gram, seg, part, c, np.full(n, ks[i]), np.full(n, ts[i]), pos - left, left)] + [pa.array(pieces, pa.binary())], names=["gram", "seg", "part", "c", "k", "t", "begin", "lead", "bytes"])

    return docs.join(wanted, ["k", "t"]).select("k", "t", "text", "w").mapInArrow(cut, "gram long, seg long, part long, c long, k long, t long, begin long, lead long, bytes binary")


def _compared(classes: DataFrame, docs: DataFrame, length: int, gram_size: int, group_rows: int) -> DataFrame:
    """Classes of anchors with several to (gram, seg, k, t, begin, early, some, open): string starts in the segment that
    have an earlier or any match in another class; open: of divided groups, those without an earlier one."""

    def compare(batches):
        held, size = [], 0

        def close(table: pa.Table):
            k, t, begin, c, lead = (table[x].to_numpy() for x in ("k", "t", "begin", "c", "lead"))
            raw = table["bytes"].combine_chunks().cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            order = np.lexsort((t, k))
            rank = np.empty(len(k), np.int64)
            rank[order] = np.cumsum(np.append(False, (k[order][1:] != k[order][:-1]) | (t[order][1:] != t[order][:-1])))
            early, some = matched_starts(data, offsets, lead, (rank << 40) + begin, length, gram_size)
            sizes = np.diff(offsets)
            for a in range(0, len(k), CUT_ROWS):
                part = table.slice(a, CUT_ROWS)
                rows = slice(a, a + len(part))
                owner, inner = np.nonzero(~early[rows] & (np.arange(early.shape[1]) <= np.minimum(lead[rows], sizes[rows] - length)[:, None]) & (c[rows] > group_rows)[:, None])
                starts = offsets[rows][owner] + inner
                hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s : s + length].data) for s in starts.tolist()), "<i8").reshape(-1, 2)
                ends = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                open_ = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(inner), *(pa.array(np.ascontiguousarray(hashes[:, i])) for i in (0, 1))], names=["i", "h", "g"]))
                yield pa.record_batch([*(part[x].combine_chunks() for x in ("gram", "seg", "k", "t", "begin")), _intervals(early[rows]), _intervals(some[rows]), open_], names=["gram", "seg", "k", "t", "begin", "early", "some", "open"])

        for batch in (part.slice(a, CUT_ROWS) for part in batches for a in range(0, len(part), CUT_ROWS)):
            held.append(batch)
            size += len(batch) * (2 * length - gram_size)
            if size < ARRAY_BYTES:
                continue
            table = pa.Table.from_batches(held)
            gram, part = table["gram"].to_numpy(), table["part"].to_numpy()
            new = np.flatnonzero((gram[1:] != gram[:-1]) | (part[1:] != part[:-1])) + 1
            if len(new):
                yield from close(table.slice(0, new[-1]))
                held = table.slice(new[-1]).combine_chunks().to_batches()
                size = sum(map(len, held)) * (2 * length - gram_size)
        if sum(map(len, held)):
            yield from close(pa.Table.from_batches(held))

    cuts = _segments(classes, docs, group_rows)
    return cuts.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(compare, f"gram long, seg long, k long, t long, begin long, early {RUNS}, some {RUNS}, open array<struct<i: long, h: long, g: long>>")


def _across_parts(results: DataFrame) -> DataFrame:
    """Adds to the classes of divided groups what only other parts' classes match: rows (gram, seg, early, some)."""
    rows = results.where(F.size("open") > 0).select("gram", "seg", "k", "t", "begin", F.explode("open").alias("o")).select("gram", "seg", "o.i", "o.h", "o.g", F.struct("k", "t", (F.col("begin") + F.col("o.i")).alias("p")).alias("place"))
    first = rows.groupBy("gram", "h", "g").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low <> high")
    hit = rows.join(first, ["gram", "h", "g"]).select("gram", "seg", F.struct(F.col("i").alias("lo"), F.col("i").alias("hi")).alias("run"), (F.col("place") > F.col("low")).alias("is_later"))
    return hit.groupBy("gram", "seg").agg(F.collect_list(F.when(F.col("is_later"), F.col("run"))).alias("more_early"), F.collect_list("run").alias("more_some"))


def duplicate_runs(docs: DataFrame, keep: str = "none", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs (k long, t long, text) to (k, t, lo, hi): runs of string starts whose strings are to be removed."""
    # Written, so that both sides of the joins are plain exchanges and a very common gram or segment, whose rows many
    # documents share, is split as a skewed join.
    repeated = written(_anchor_rows(docs, length, gram, False).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    rows = written(_anchor_rows(docs, length, gram, True).join(repeated, "gram"))
    classes = written(rows.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "spot")).alias("first")))
    several = written(classes.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"))
    single = classes.join(several, "gram").select("gram", "seg", "first.k", "first.t", "first.spot", "c")
    results = written(_compared(single, docs, length, gram, group_rows))
    more = _across_parts(results)
    none = F.array().cast(RUNS)
    found = results.join(more, ["gram", "seg"], "left").select("gram", "seg", *[F.concat(c, F.coalesce(f"more_{c}", none)).alias(c) for c in ("early", "some")])
    verdict = classes.join(found, ["gram", "seg"], "left").select("gram", "seg", "n", "first", *[F.coalesce(c, none).alias(c) for c in ("early", "some")])
    begin = F.shiftright("spot", 20) - F.shiftright("spot", 10).bitwiseAND(F.lit(1023))
    last = F.shiftright("spot", 20) + F.col("spot").bitwiseAND(F.lit(1023)) - F.lit(length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (last - begin).cast("long").alias("hi")))
    if keep == "none":
        wanted = verdict.where((F.col("n") > 1) | (F.size("some") > 0))
        runs = F.when(F.col("n") > 1, whole).otherwise(F.col("some"))
    elif keep == "first":
        wanted = verdict.where((F.col("n") > 1) | (F.size("early") > 0))
        runs = F.when(F.struct("k", "t", "spot") != F.col("first"), whole).otherwise(F.col("early"))
    else:
        raise ValueError(f"keep is {keep!r}, not 'none' or 'first'")
    wanted = written(wanted)
    each = rows.join(wanted, ["gram", "seg"]).select("k", "t", begin.alias("begin"), F.explode(runs).alias("run"))
    return each.where("run.hi >= run.lo").select("k", "t", (F.col("begin") + F.col("run.lo")).alias("lo"), (F.col("begin") + F.col("run.hi")).alias("hi"))


def remove_repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "none", whole_characters: bool = False, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The columns of docs, `kept` (binary: the remaining bytes) and `removed` (maximal runs as (start, end) in bytes).
    With whole_characters, runs shrink to whole characters."""
    if not 128 <= length <= 255 or not 8 <= gram <= length:
        raise ValueError("strings have 128 to 255 bytes, grams 8 bytes at least and no more than a string")
    plain, at = numbered(docs)
    key, text = at[key], at[text]
    # Rows are known by a hash of key and text; the key itself is carried where the order of rows matters.
    first = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)) if keep == "first" else F.lit(0).cast("long")
    known = plain.withColumns({"k": first, "t": F.xxhash64(key, text)})
    lean = known.select("k", "t", F.col(text).alias("text"))
    runs = duplicate_runs(lean, keep, length, gram, group_rows).groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    names = {at[c]: c for c in docs.columns if c.lower() not in ("kept", "removed")}
    joined = known.join(runs, ["k", "t"], "left").select(F.col(text).alias("text"), "runs", *names)

    def cut(batches):
        for batch in (part.slice(a, 256) for part in batches for a in range(0, len(part), 256)):
            lists = batch.column("runs")
            low, high, ends = lists.values.field("lo").to_numpy(), lists.values.field("hi").to_numpy(), lists.offsets.to_numpy()
            out, removed = [], []
            for i, t in enumerate(batch.column("text")):
                raw = (t.as_py() or "").encode("utf-8")
                lo, hi = low[ends[i] : ends[i + 1]], high[ends[i] : ends[i + 1]] + length
                spans = []
                if len(lo):
                    top = np.maximum.accumulate(hi)
                    new = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
                    spans = list(zip(lo[new].tolist(), top[np.append(new[1:], len(lo)) - 1].tolist()))
                if whole_characters:
                    spans = [(s, e) for s, e in ((_forward(raw, s), _back(raw, e)) for s, e in spans) if s < e]
                edges = [0, *(x for s in spans for x in s), len(raw)]
                out.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"start": s, "end": e} for s, e in spans])
            yield pa.record_batch([*batch.columns[2:], pa.array(out, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[*names, "kept", "removed"])

    fields = "".join(f"{c} {plain.schema[c].dataType.simpleString()}, " for c in names)
    cleaned = joined.mapInArrow(cut, f"{fields}kept binary, removed array<struct<start: long, end: long>>")
    return cleaned.select(*[F.col(c).alias(name) for c, name in names.items()], "kept", "removed")


def _forward(raw: bytes, i: int) -> int:
    while i < len(raw) and raw[i] & 0xC0 == 0x80:
        i += 1
    return i


def _back(raw: bytes, i: int) -> int:
    while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
        i -= 1
    return i
