"""Best-fit packing of tokenized documents into fixed-length sequences.

Best-fit decreasing over document pieces needs only how many pieces there are of each length, and lengths are bounded by
the capacity. So the packing is planned for runs of equal pieces: a segment tree over remaining capacities finds the
tightest open bins for the next length in logarithmic time, and a whole run of bins with that capacity is filled at
once. The plan has at most a few entries for each pair of length and capacity, whatever the number of documents; each
piece then takes its place from its rank among the pieces of its length, which is found by buckets of a hash, so that a
length that a third of all pieces has is not ranked in one task.

Defined results: a null text is empty and packs as its end token alone; an empty table gives no rows; repeated rows are
packed separately; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

CAPACITY = 1024
END_ID = 2
#: Pieces for each bucket in which pieces of one length are ranked.
BUCKET_ROWS = 2000


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the
    others, in order, are the code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class ByteEncoder:
    """Ids of a byte-level BPE file of the tokenizers library, special strings included, without adding any.

    Where merges stand in the order of ids, as in the common files, the faster tiktoken does the merging; the other
    files, and texts that its regular expressions give up on, go to the tokenizers library itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self._path, self._plain, self._fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added, model = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or [], spec["model"]
        vocab, byte_of = model["vocab"], byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab["".join(m)] for m in merges]
        if (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and order == sorted(order)
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)
        ):
            import tiktoken

            special = {x["content"]: x["id"] for x in added}
            ranks = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in special}
            self._fast, self._special = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special), list(special)

    def __call__(self, text: str) -> list[int]:
        if self._fast is not None:
            try:
                if any(s in text for s in self._special):
                    return self._fast.encode(text, allowed_special="all")
                return self._fast.encode_ordinary(text)
            except ValueError:
                pass
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self._path)
        return self._plain.encode(text, add_special_tokens=False).ids


@lru_cache(2)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Per piece: key, piece, start (tokens before it), length, ids_crc32 (of little-endian unsigned 32-bit ids) and, if
    asked for, ids. Documents longer than the capacity are cut; then the first piece takes the remainder."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def pieces(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for a in range(0, len(batch), 256):
                row, piece, start, length, crc, flat = [], [], [], [], [], []
                for i, t in enumerate(batch.column(1).slice(a, 256).to_pylist(), a):
                    ids = np.array([*encode(t or ""), end_id], "<u4")
                    head = len(ids) % capacity or capacity
                    cuts = [0, *range(head, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i), piece.append(k), start.append(s), length.append(e - s)
                        crc.append(zlib.crc32(ids[s:e].tobytes()))
                    if with_ids:
                        flat.append(ids.astype(np.int32))
                out = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))))
                yield pa.record_batch(out, names=names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(pieces, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class CapacityTree:
    """Segment tree over capacities 0..top: how many bins are open with each, and the tightest one that fits."""

    def __init__(self, top: int):
        self._size = 1 << top.bit_length()
        self._has = [False] * (2 * self._size)

    def put(self, capacity: int, has: bool) -> None:
        i = capacity + self._size
        self._has[i] = has
        while i := i // 2:
            self._has[i] = self._has[2 * i] or self._has[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least with open bins."""
        i = least + self._size
        if self._has[i]:
            return least
        while i > 1:  # up until a right sibling has bins, then down to its leftmost
            if i % 2 == 0 and self._has[i + 1]:
                i += 1
                while i < self._size:
                    i = 2 * i if self._has[2 * i] else 2 * i + 1
                return i - self._size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """How many pieces there are of each length, to entries (length, first rank, pieces a bin, first bin, offset): from
    that rank on, pieces fill bins one after the other, so many to each, from that offset."""
    tree, open_bins, plan, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, deque()).append((first, n))
            tree.put(room, True)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                need = -(-left // (room // length))
                first, n = bins, need
                bins += need
            else:
                first, n = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.put(room, False)
            each = room // length
            take = min(left, n * each)
            full, part = divmod(take, each)
            plan.append((length, rank, each, first, capacity - room))
            put(room - each * length, first, full)
            if part:
                put(room - part * length, first + full, 1)
            put(room, first + full + bool(part), n - full - bool(part))
            rank, left = rank + take, left - take
    return plan


def pack_pieces(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (key, piece, length, ids_crc32; lengths from 1 to the capacity).

    The table is read twice, so it should be a written one."""
    # Of bounded size: one row for each length.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(best_fit_plan(counts, capacity))
    n_buckets = max(1, sum(counts.values()) // bucket_rows)
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(n_buckets)))
    cells = spread.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = cells.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32"))
    ranked = spread.withColumn("_within", within - 1).join(before, ["length", "_bucket"])
    table = np.array(plan, np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast((table, (table[:, 0] << 44) + table[:, 1]))
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_within")).alias("_rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches):
        entries, start = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            e = entries[np.searchsorted(start, (length << 44) + rank, "right") - 1] if len(entries) else np.zeros((0, 5), np.int64)
            step = rank - e[:, 1]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*columns, pa.array(e[:, 3] + step // e[:, 2]), pa.array(e[:, 4] + step % e[:, 2] * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack: per piece key, piece, start, length, ids_crc32, ids if asked for, sequence_id, offset."""
    return pack_pieces(written(tokenized_pieces(docs, tokenizer, text, key, capacity, end_id, with_ids)), key, capacity)
