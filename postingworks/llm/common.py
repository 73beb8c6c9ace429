"""What the text operators share: Arrow text columns as flat byte arrays, and tables kept in the cluster's shared folder.

Python operators see each Arrow batch as one byte buffer with offsets and work on blocks of it, so memory follows the
block size and not the batch; texts are always whole. A null text is an empty one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python operator holds unpacked at once; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20

#: Spark's setting by which shuffle files go when a query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that `written` made within each open `scratch`.
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one in local mode, as in tests; a cluster
    has no folder of ours that all machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="postingworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go with its end; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, outlives: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The table goes at the end of the innermost `scratch`. Outside of one, or if it outlives it, it goes with the session,
    as a result that reads it may be used at any later time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postingworks-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _open and not outlives:
        _open[-1].append(out)
    else:
        fs, p = _path(spark, path)
        fs.deleteOnExit(p)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `written` that nothing will read again."""
    fs, p = _path(df.sparkSession, df._written_at)
    fs.delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written within are deleted at the end; whatever reads them must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for table in _open.pop():
            discard(table)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: first row, row after the last, bytes, offsets from 0."""
    if not len(texts):
        return
    raw, at = flat(texts)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text the index of its first word (n + 1)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts, ends = runs(inside, at)
    return starts, ends, np.searchsorted(starts, at)


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values that don't cross an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = at[:-1][np.diff(at) > 0]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last[:-1] &= ~inside[1:]
    last[cuts[1:] - 1] = inside[cuts[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each byte range, as uint64."""
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


#: Two primes under 2^31 and a base for each; a hash of both is known to agree on unequal ranges by chance only.
_PRIMES = ((2147483647, 1220703125), (2147483629, 1103515245))
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(prime: int, base: int, n: int) -> np.ndarray:
    """The first n powers of the base; kept for blocks of the usual size."""
    size = max(n, BLOCK_BYTES + 2)
    if (prime, base) in _powers and len(_powers[prime, base]) >= n:
        return _powers[prime, base][:n]
    out = np.ones(1, np.uint64)
    while len(out) < size:  # doubles: the second half is the first one times a power
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
    out = out[:size].astype(np.uint32)
    if size == BLOCK_BYTES + 2:  # not those of a rare, very long text
        _powers[prime, base] = out
    return out[:n]


def even_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 62-bit polynomial hash of each byte range, scrambled to uint64: without a step a range, for ranges that overlap."""
    x = np.zeros(len(starts), np.uint64)
    for prime, base in _PRIMES:
        p = np.uint64(prime)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _power(prime, base, len(data))
        if len(data) >= 1 << 23:  # sums of terms under 2^40 fit in 64 bits up to there
            terms %= p
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        own = (total[ends] - total[starts]) % p * _power(prime, pow(base, -1, prime), len(data) + 1)[starts] % p
        x = x << np.uint64(31) | own
    return mixed(x)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named c0, c1, ..., so that no name of an operator's own can clash; and the new names."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), at
