"""Exact top-k inner-product search with KD-trees per shard.

A KD-tree has median splits along the widest side down to small leaves, every node with its tight bounding box. Its upper
part is fitted on a bounded sample and deals all vectors to cells; the vectors of a cell form a shard, or several where
they are too many, each with a tree of its own. For a query the largest inner product inside a box is the sum of the
larger of q times lower and q times upper side. A shard is searched best bound first, from the root on, until no bound
reaches the k-th score so far. The k-th score is carried over shards: a query first meets its own cell, then, with the
k-th score found there, those other cells whose boxes reach it. Shards stay in their task and queries stream past them;
where very many queries go to one shard, it is copied for each `QUERY_ROWS` of them.

Of equal vectors only the k + 1 smallest ids can be among the k best of any query, so all others go before the search,
by a rank that is limited before its shuffle: one vector that a third of all rows have costs nothing further.

Scores are exact 64-bit integers. Defined results: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; vectors of different lengths never meet; ties go to the smaller id; repeated rows
are one vector, different vectors of one id are candidates each and share the result as queries; a query with fewer other
vectors gets all of them; other columns are ignored. Scores that don't fit in a long are clipped to its range.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

LEAF_ROWS = 64
#: Vectors of a cell, as far as the sample allows; with 8 rows of the sample to a cell there are 1,024 cells at most.
CELL_ROWS = 2048
SAMPLE_ROWS = 8192
#: Vectors of one tree at most, about; larger cells are several shards.
TREE_ROWS = 1 << 16
#: Queries for each copy of a shard.
QUERY_ROWS = 1 << 16
QUERY_BLOCK = 512
#: The cell of vectors whose length the sample doesn't have; it has no box.
REST = -1


def integers(column: str, scale: int = 256):
    """floor(scale * x) of each component x as a double."""
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


class KDTree:
    """Nodes of one tree, the root first: low and high sides, children (left, left + 1; 0 for leaves), side and value of
    the split, rows of the leaves."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        low, high, left, side, value, self.rows = [], [], [], [], [], []
        todo = [np.arange(len(vectors))]
        for rows in todo:  # grows on the way: nodes stand level by level
            own = vectors[rows]
            low.append(own.min(axis=0)), high.append(own.max(axis=0))
            wide = high[-1] - low[-1]
            axis = int(wide.argmax()) if len(wide) else 0
            if len(rows) <= leaf_rows or not len(wide) or wide[axis] == 0:
                left.append(0), side.append(0), value.append(0.0), self.rows.append(rows)
                continue
            order = np.argsort(own[:, axis], kind="stable")
            cut = own[order[len(rows) // 2], axis]
            if cut == low[-1][axis]:  # the median is the least value: those above it go right
                cut = own[:, axis][own[:, axis] > cut].min()
            below = own[:, axis] < cut
            left.append(len(todo)), side.append(axis), value.append(float(cut)), self.rows.append(None)
            todo += [rows[below], rows[~below]]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.side, self.value = np.array(left), np.array(side), np.array(value)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest possible score of each query in each node."""
        return box_bounds(queries, self.low, self.high)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls to by the splits."""
        node = np.zeros(len(vectors), np.int64)
        while (inner := np.flatnonzero(self.left[node] > 0)).size:
            at = node[inner]
            node[inner] = self.left[at] + (vectors[inner, self.side[at]] >= self.value[at])
        return node


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as exact integers; floats suffice while no partial sum passes 2**53."""
    if len(q) and len(v) and float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] >= 2.0**53:
        big = q.astype(np.int64).astype(object) @ v.astype(np.int64).astype(object).T
        return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return (q @ v.T).astype(np.int64)


def _reaches(bound, kth):
    """If a bound, a sum of doubles, may stand for a score of at least kth."""
    return bound >= kth - np.abs(kth) * 1e-9


def search(tree: KDTree, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Best (score, -id) of each query over a tree's vectors, other ids only, scores of kth at least; a min-heap for each.

    Each query takes its best node off its own heap of bounds; queries that arrive at one leaf at the same step share a
    matrix product."""
    bounds = tree.bounds(queries)
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    least = kth.astype(float)
    fronts = [[(-b, 0)] for b in bounds[:, 0].tolist()]
    live = range(len(query_ids))
    while live:
        at: dict[int, list[int]] = {}
        for i in live:
            front, bound, low = fronts[i], bounds[i], least[i] - abs(least[i]) * 1e-9 if np.isfinite(least[i]) else -np.inf
            while front and -front[0][0] >= low:
                _, node = heapq.heappop(front)
                child = tree.left[node]
                if not child:
                    at.setdefault(node, []).append(i)
                    break
                for c in (child, child + 1):
                    if bound[c] >= low:
                        heapq.heappush(front, (-bound[c], c))
        for node, who in at.items():
            rows = tree.rows[node]
            scores, own = _exact(queries[who], vectors[rows]), ids[rows]
            for i, s in zip(who, scores):
                heap = best[i]
                able = np.flatnonzero((s >= least[i]) & (own != query_ids[i]))
                if len(able) > 2 * k:  # only the best k can matter, with all that tie with the last of them
                    able = able[s[able] >= np.partition(s[able], len(able) - k)[len(able) - k]]
                for score, other in zip(s[able].tolist(), own[able].tolist()):
                    item = (score, -other)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                if len(heap) == k:
                    least[i] = max(least[i], heap[0][0])
        live = [i for who in at.values() for i in who]
    return best


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim).astype(np.float64)


def _by_dim(batch, column: str = "v", dim: str = "dim"):
    """Rows of each vector length: (length, row numbers, matrix)."""
    dims = batch.column(dim).to_numpy()
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield int(d), rows, _matrix(batch.column(column).take(pa.array(rows)), int(d))


def _dealt(rows: DataFrame, tops: dict[int, tuple[int, KDTree]]) -> DataFrame:
    """Adds `cell` to rows with v and dim. tops: by length, the number of its first cell and the upper tree."""
    shared = rows.sparkSession.sparkContext.broadcast(tops)  # fitted on SAMPLE_ROWS vectors

    def deal(batches):
        for batch in batches:
            cell = np.full(len(batch), REST, np.int64)
            for d, at, v in _by_dim(batch):
                if d in shared.value:
                    first, top = shared.value[d]
                    cell[at] = first + top.leaf_of(v)
            yield pa.record_batch([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(deal, f"{fields}, cell long")


def _boxes(candidates: DataFrame) -> pa.Table:
    """Per cell: cell, dim, n, low, high; of REST only n. A row a cell, so of bounded size."""

    def part(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for d, at, v in _by_dim(batch):
                for c in np.unique(cells[at]):
                    own = v[cells[at] == c]
                    old = held.setdefault((int(c), d if c != REST else 0), [0, None, None])
                    old[0] += len(own)
                    if c != REST:
                        low, high = own.min(axis=0), own.max(axis=0)
                        old[1], old[2] = (low, high) if old[1] is None else (np.minimum(old[1], low), np.maximum(old[2], high))
        keys = list(held)
        yield pa.record_batch([pa.array([c for c, _ in keys], pa.int64()), pa.array([d for _, d in keys], pa.int32()), pa.array([held[x][0] for x in keys], pa.int64()), *(pa.array([None if held[x][i] is None else held[x][i].tolist() for x in keys], pa.list_(pa.float64())) for i in (1, 2))], names=["cell", "dim", "n", "low", "high"])

    def merge(table: pa.Table) -> pa.Table:
        dim, n = table["dim"][0].as_py(), sum(table["n"].to_pylist())
        low, high = (None, None) if table["low"][0].as_py() is None else (_matrix(table["low"], dim).min(axis=0).tolist(), _matrix(table["high"], dim).max(axis=0).tolist())
        return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int64()), "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64()))})

    kind = "cell long, dim int, n long, low array<double>, high array<double>"
    return candidates.mapInArrow(part, kind).groupBy("cell").applyInArrow(merge, kind).toArrow()


def _met(queries: DataFrame, candidates: DataFrame, parts: dict[int, int], k: int) -> DataFrame:
    """Queries (id, v, dim, cell, kth) against the candidates of their cells: query_id, id, score, rank; k for each at most."""
    spread = lambda c, n: F.pmod(F.xxhash64(c), n)
    table = F.create_map(*[F.lit(x).cast("long") for item in parts.items() for x in item])
    shards = F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(0).cast("long"))
    asked = queries.groupBy("cell").agg(F.count("*").alias("q")).toArrow()  # a row a cell
    times = {c: -(-q // QUERY_ROWS) for c, q in zip(asked["cell"].to_pylist(), asked["q"].to_pylist())}
    if not times:
        times = {REST - 1: 1}
    copies = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for item in times.items() for x in item]), F.col("cell"))
    numbers = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))
    home = candidates.withColumn("copy", numbers(copies)).select("cell", spread("id", shards).alias("part"), "copy", F.lit(False).alias("asks"), "id", "v", "dim", F.lit(None).cast("long").alias("kth"))
    going = queries.withColumn("part", numbers(shards)).select("cell", "part", spread("id", copies).alias("copy"), F.lit(True).alias("asks"), "id", "v", "dim", "kth")

    def meet(batches):
        key, held, trees = None, [], None

        def grown():
            table = pa.Table.from_batches(held)
            return {d: (KDTree(v), table["id"].to_numpy()[at], v) for d, at, v in _by_dim(table)}

        for batch in batches:
            whole = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "copy")], axis=1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((whole[1:] != whole[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                if key != (key := tuple(whole[a])) or trees is not None and not asks[a]:
                    held, trees = [], None
                run = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(run)
                    continue
                if trees is None:
                    trees = grown() if held else {}
                for c in range(0, len(run), QUERY_BLOCK):
                    block = run.slice(c, QUERY_BLOCK)
                    kth = block.column("kth").to_numpy(zero_copy_only=False).astype(float)
                    for d, at, q in _by_dim(block):
                        if d in trees:
                            tree, ids, v = trees[d]
                            who = block.column("id").to_numpy()[at]
                            found = search(tree, ids, v, who, q, np.where(np.isnan(kth[at]), -np.inf, kth[at]), k)
                            out = np.array([(i, -x, s) for i, heap in zip(who.tolist(), found) for s, x in heap], np.int64).reshape(-1, 3)
                            yield pa.record_batch([pa.array(np.ascontiguousarray(out[:, j])) for j in range(3)], names=["query_id", "id", "score"])

    both = home.unionByName(going).repartition("cell", "part", "copy").sortWithinPartitions("cell", "part", "copy", "asks")
    return _best(both.mapInArrow(meet, "query_id long, id long, score long"), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", "id", "score").withColumn("rank", nth).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, cell_rows: int = CELL_ROWS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Per query (rows where the column `is_query` holds): query_id, rank from 1, the key of the match, score."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), is_query.alias("q"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(~bad).select("id", F.coalesce("q", F.lit(False)).alias("q"), integers("x", scale).alias("v"))
    rows = written(rows.groupBy("id", "v").agg(F.max("q").alias("query")).withColumn("dim", F.size("v")))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = rows.select("id", "v", "dim", nth.alias("nth")).where(F.col("nth") <= k + 1).drop("nth")
    sample = rows.select("v", "dim").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).toArrow()
    n, tops, first = rows.count(), {}, 0
    for d, _, v in _by_dim(sample) if len(sample) else ():
        tops[d] = (first, KDTree(v, max(8, cell_rows * len(sample) // max(n, 1))))
        first += len(tops[d][1].left)
    candidates = written(_dealt(candidates, tops))
    boxes = _boxes(candidates)
    parts = {c: -(-m // tree_rows) for c, m in zip(boxes["cell"].to_pylist(), boxes["n"].to_pylist())} or {REST: 0}
    queries = written(_dealt(rows.where("query").select("id", "v", "dim"), tops))
    begun = written(_met(queries.withColumn("kth", F.lit(None).cast("long")), candidates, parts, k))
    kth = begun.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    by_dim: dict[int, tuple] = {}
    for d in set(boxes["dim"].to_pylist()) - {0}:
        own = boxes.filter(pc.equal(boxes["dim"], d))
        by_dim[d] = (own["cell"].to_numpy(), _matrix(own["low"], d), _matrix(own["high"], d))
    shared = rows.sparkSession.sparkContext.broadcast(by_dim)  # a box for each of 1,024 cells at most

    def route(batches):
        for batch in batches:
            least, cell = batch.column("kth").to_numpy(zero_copy_only=False).astype(float), batch.column("cell").to_numpy()
            for d, at, q in _by_dim(batch):
                if d not in shared.value:
                    continue
                cells, low, high = shared.value[d]
                floor = np.where(np.isnan(least[at]), -np.inf, least[at])[:, None]
                with np.errstate(invalid="ignore"):
                    go = np.isneginf(floor) | _reaches(box_bounds(q, low, high), floor)
                who, to = np.nonzero(go & (cells[None, :] != cell[at][:, None]))
                part = batch.take(pa.array(at[who]))
                yield pa.record_batch([part.column("id"), part.column("v"), part.column("dim"), pa.array(cells[to]), part.column("kth")], names=["id", "v", "dim", "cell", "kth"])

    others = queries.join(kth, "id", "left").select("id", "v", "dim", "cell", "kth").mapInArrow(route, "id long, v array<long>, dim int, cell long, kth long")
    final = _best(begun.select("query_id", "id", "score").unionByName(_met(written(others), candidates, parts, k).select("query_id", "id", "score")), k)
    return final.select("query_id", "rank", F.col("id").alias(key), "score")
