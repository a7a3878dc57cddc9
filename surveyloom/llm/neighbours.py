"""Nearest neighbours by inner product with a forest of random-projection trees.

Vectors get one more component, so that the largest inner product is the least
angle (queries get a zero there). Trees are fitted on a bounded sample: a node
splits at the median along the difference of two random points. Every vector
of the table is then filed by its path. A query walks all trees at once through
one priority queue, ordered by the distance to the splits it has crossed, until
the leaves it has seen hold enough vectors; these are reranked exactly.

Vectors are dealt in slices by a hash of their id, and a query goes to every
slice with the list of its leaves. A task holds one slice and lets the queries
stream past, so neither side passes through the driver or a broadcast.
"""

from __future__ import annotations

import heapq
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import broadcast_value, sampled, ship, written

SAMPLE = 16_384
FOREST_BYTES = 256_000_000
#: Bytes of the vectors (as doubles) that a slice holds, and of queries at once.
SLICE_BYTES, BLOCK_BYTES = 64_000_000, 16_000_000


class Tree(NamedTuple):
    """A full binary tree of ``depth`` levels; node k's children are 2k+1, 2k+2."""

    normals: np.ndarray  # (nodes, dims)
    offsets: np.ndarray


class Forest(NamedTuple):
    depth: int
    trees: list[Tree]
    largest: float  # the largest norm of the table
    sizes: np.ndarray  # vectors of the whole table by (tree, leaf)


def valid(embeddings: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, v: array<double>) without null, zero, or non-finite vectors, and of
    ``dims`` components if given."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.filter(F.coalesce(ok, F.lit(False)))
    return rows if dims is None else rows.filter(F.size("v") == dims)


def _raised(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.maximum(0.0, largest**2 - (x * x).sum(axis=1))
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def grow(points: np.ndarray, trees: int, leaf: float, seed: int, most: int = FOREST_BYTES) -> tuple[int, list[Tree]]:
    """Trees down to leaves of about ``leaf`` points, or as deep as ``most`` bytes of
    normals let them be; leaves of fewer levels hold more."""
    rng = np.random.default_rng(seed)
    dims = points.shape[1]
    fits = int(np.log2(most // (trees * dims * 8) + 1))
    depth = min(max(0, int(np.ceil(np.log2(max(1, len(points)) / leaf)))), fits)
    nodes = 2**depth - 1
    out = []
    for _ in range(trees):
        normals, offsets = np.zeros((nodes, dims)), np.zeros(nodes)
        inside = {0: np.arange(len(points))}
        for k in range(nodes):
            here = inside.pop(k)
            if len(here) >= 2:
                a, b = points[rng.choice(here, 2, replace=False)]
                n = a - b
            else:
                n = rng.standard_normal(dims)
            norm = np.linalg.norm(n)
            if norm < 1e-12:
                n = rng.standard_normal(dims)
                norm = np.linalg.norm(n)
            normals[k] = n / norm
            side = points[here] @ normals[k]
            offsets[k] = np.median(side) if len(here) else 0.0
            inside[2 * k + 1], inside[2 * k + 2] = here[side < offsets[k]], here[side >= offsets[k]]
        out.append(Tree(normals, offsets))
    return depth, out


def leaves(tree: Tree, depth: int, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        side = np.einsum("ij,ij->i", x, tree.normals[node]) >= tree.offsets[node]
        node = 2 * node + 1 + side
    return node - (2**depth - 1)


def search(forest: Forest, q: np.ndarray, enough: int) -> list[int]:
    """Leaves (tree * 2^depth + leaf) for one raised query, best first, until they
    hold ``enough`` vectors of the table (one filed in several trees counts in each)."""
    width = 2**forest.depth
    sides = [t.normals @ q - t.offsets for t in forest.trees]
    queue: list[tuple[float, int, int]] = [(0.0, k, 0) for k in range(len(forest.trees))]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < enough:
        crossed, k, node = heapq.heappop(queue)
        while node < width - 1:
            s = sides[k][node]
            near, far = (2 * node + 2, 2 * node + 1) if s >= 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(crossed, abs(s)), k, far))
            node = near
        leaf = node - (width - 1)
        out.append(k * width + leaf)
        held += int(forest.sizes[k, leaf])
    return out


def fit(rows: DataFrame, dims: int, trees: int = 32, leaf: int = 64, sample: int = SAMPLE, seed: int = 11) -> Forest:
    """A forest on about ``sample`` vectors, those of ids under a threshold by hash; leaf
    sizes count every vector of the table. Leaves hold about ``leaf`` vectors of
    the whole table, or two of the sample if that is more, or as many as leave the
    forest in FOREST_BYTES, whatever the dimensions."""
    ship(rows.sparkSession)
    total, largest = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    largest = float(np.sqrt(largest or 0.0))
    chosen = sampled(rows.select(F.col("vec_id").cast("string").alias("id"), "v"), sample, 1.0).distinct()
    got = sorted(chosen.limit(2 * sample).collect(), key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["v"]))
    points = _raised(np.array([r["v"] for r in got], dtype=np.float64).reshape(-1, dims), largest)
    least = max(2.0, leaf * len(points) / max(1, total))
    depth, grown = grow(points, trees, least, seed)
    bare = Forest(depth, grown, largest, np.zeros((trees, 2**depth), dtype=np.int64))
    shared = broadcast_value(rows.sparkSession, bare, sum(t.normals.nbytes for t in grown), FOREST_BYTES, "forest")

    def run(batches):
        f = shared.value
        sizes = np.zeros_like(f.sizes)
        for b in batches:
            x = _raised(_matrix(b.column(0), dims), f.largest)
            for k, t in enumerate(f.trees):
                sizes[k] += np.bincount(leaves(t, f.depth, x), minlength=sizes.shape[1])
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes.ravel()[at])], ["at", "n"])

    for r in rows.select("v").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        bare.sizes.ravel()[r["at"]] = r["n"]
    return bare


def _matrix(column, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k first ids of each query by their best score, then id."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    fresh = np.r_[True, (np.diff(query) != 0) | (np.diff(ids) != 0)] if len(query) else np.zeros(0, bool)
    query, ids, scores = query[fresh], ids[fresh], scores[fresh]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, np.diff(query) != 0]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[place < k], ids[place < k], scores[place < k]


def _kth_other(near: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th best product over distinct ids but its own, -inf if there are
    fewer; ``ids`` are the columns' ids in order."""
    starts = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
    if len(starts) < k:
        return np.full(len(near), -np.inf)
    best, names = near.copy() if len(starts) == len(ids) else np.maximum.reduceat(near, starts, axis=1), ids[starts]
    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
    mine = np.flatnonzero(names[at] == own)
    best[mine, at[mine]] = -np.inf
    return np.partition(best, len(names) - k, axis=1)[:, len(names) - k]


def _once(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, those of equal id and vector once."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    if (np.diff(ids) != 0).all():
        return x, ids
    rows = np.ascontiguousarray(np.c_[x.view(np.int64), ids])
    first = np.sort(np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True)[1])
    return x[first], ids[first]


class _Best:
    """A task's k best for each query, and the score that each query's k-th has."""

    def __init__(self, queries: tuple, k: int):
        self.q_ids, self.q, self.by_leaf = queries  # ids, vectors, leaf to queries
        self.k = k
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.floor = np.full(len(self.q_ids), -np.inf)

    def add(self, x: np.ndarray, ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Scores (query, vector) pairs, each in one fixed order of summation, so
        that equal vectors tie exactly."""
        if not pairs:
            return
        a, b = (np.concatenate(p) for p in zip(*pairs))
        scores = np.concatenate([(self.q[a[s : s + 50_000]] * x[b[s : s + 50_000]]).sum(axis=1) for s in range(0, len(a), 50_000)])
        self.held = _best(*(np.concatenate(p) for p in zip(self.held, (a, ids[b], scores))), self.k)
        full = np.bincount(self.held[0], minlength=len(self.floor)) == self.k
        last = np.full(len(self.floor), -np.inf)
        last[self.held[0]] = self.held[2]  # a query's last row is its k-th
        self.floor = np.where(full, last, -np.inf)

    def rerank(self, filed: _Slice, most: int = 400_000) -> None:
        """Takes in the slice's vectors for each query that has seen their leaves.

        One matrix product a leaf tells which pairs can matter, given what each
        query has reached; only those are kept, and scored ``most`` at a time.
        What can matter is told over distinct vec_ids without the query's own,
        so that repeated rows take no other candidate's place.
        """
        x, ids, k = filed.x, filed.ids, self.k
        pairs, held = [], 0
        for leaf, asking_all in self.by_leaf.items():
            mine = filed.members(leaf)
            if not len(mine):
                continue
            for at in range(0, len(asking_all), max(1, most // len(mine))):
                asking = asking_all[at : at + max(1, most // len(mine))]
                near = self.q[asking] @ x[mine].T
                least = np.maximum(self.floor[asking], _kth_other(near, ids[mine], self.q_ids[asking], k))
                slack = 1e-9 * (1 + np.abs(np.maximum(least, -1e300)))
                a, b = np.nonzero(near >= (least - slack)[:, None])
                a, b = asking[a].astype(np.int64), mine[b]
                other = self.q_ids[a] != ids[b]
                pairs.append((a[other], b[other]))
                held += len(a)
                if held >= most:
                    self.add(x, ids, pairs)
                    pairs, held = [], 0
        self.add(x, ids, pairs)


class _Slice:
    """A slice's vectors by id, and which of them are in each leaf."""

    def __init__(self, forest: Forest, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = _once(x, ids)
        raised = _raised(self.x, forest.largest)
        self.width = 2**forest.depth
        self.order, self.starts = [], []
        for tree in forest.trees:
            leaf = leaves(tree, forest.depth, raised)
            order = np.argsort(leaf, kind="stable").astype(np.int32)
            self.order.append(order)
            self.starts.append(np.searchsorted(leaf[order], np.arange(self.width + 1)))

    def members(self, leaf: int) -> np.ndarray:
        t, k = divmod(leaf, self.width)
        return self.order[t][self.starts[t][k] : self.starts[t][k + 1]]


def _by_leaf(seen: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Which queries ask for each leaf."""
    leaf, q = np.concatenate(seen), np.repeat(np.arange(len(seen), dtype=np.int32), [len(x) for x in seen])
    order = np.argsort(leaf, kind="stable")
    leaf, q = leaf[order], q[order]
    starts = np.flatnonzero(np.r_[True, np.diff(leaf) != 0])
    return {int(leaf[s]): q[s:e] for s, e in zip(starts, np.r_[starts[1:], len(leaf)])}


DEALT = "slice int, query boolean, vec_id long, v array<double>, leaves array<int>"
OUT = "query_id long, vec_id long, score double"


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, trees: int = 32, share: float = 0.4, least: int = 2500) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each query.

    Queries are the vectors whose vec_id is divisible by ``every``; candidates
    are all vectors but those of the query's own vec_id. A query looks at
    leaves until they hold ``share`` of the table and ``least`` vectors more,
    one filed in several trees counting in each. (Directions that are uniform
    in 64 dimensions need as much for nine of ten neighbours; where vectors
    crowd together a much smaller share will do.)

    Vectors that are null, zero, of another length than the table's most
    frequent one, or hold null or non-finite components take no part; repeated
    vec_ids are one candidate, of the better score, and ties go to the smaller
    vec_id. An empty table gives no rows; other columns play no part.
    """
    spark = embeddings.sparkSession
    known = valid(embeddings)
    common = known.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = common["n"]
    rows = valid(embeddings, dims)
    forest = fit(rows, dims, trees)
    total = int(forest.sizes[0].sum())
    enough = int(share * total) + least
    shared = broadcast_value(spark, forest, sum(t.normals.nbytes for t in forest.trees), FOREST_BYTES, "forest")

    def look(batches):
        f = shared.value
        for b in batches:
            q = _matrix(b.column("v"), dims)
            flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
            found = [search(f, x, enough) for x in flat]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(found, pa.list_(pa.int32()))], ["vec_id", "v", "leaves"])

    cores = max(1, spark.sparkContext.defaultParallelism)
    slices = max(min(cores, total // 2048), -(-total * dims * 8 // SLICE_BYTES), 1)
    asked = rows.filter(F.col("vec_id") % every == 0).repartition(cores).mapInArrow(look, "vec_id long, v array<double>, leaves array<int>")
    asked = written(asked, "queries")
    by_id = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    filed = rows.select(by_id.alias("slice"), F.lit(False).alias("query"), "vec_id", "v", F.lit(None).cast("array<int>").alias("leaves"))
    to_all = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("query"), "vec_id", "v", "leaves")
    # A slice's vectors first, then the queries.
    dealt = filed.unionAll(to_all).repartition(slices, "slice").sortWithinPartitions("slice", "query", "vec_id")

    def answers(f: Forest, held: list, queries: list):
        here = _Slice(f, np.concatenate([x for x, _ in held]), np.concatenate([i for _, i in held])) if isinstance(held, list) else held
        q_ids, q = np.concatenate([i for i, _, _ in queries]), np.concatenate([x for _, x, _ in queries])
        best = _Best((q_ids, q, _by_leaf([x for _, _, several in queries for x in several])), k)
        best.rerank(here)
        return here, pa.RecordBatch.from_arrays([pa.array(q_ids[best.held[0]]), pa.array(best.held[1]), pa.array(best.held[2])], ["query_id", "vec_id", "score"])

    def rerank(batches):
        f = shared.value
        at, held, queries, size = -1, [], [], 0
        for b in batches:
            which, kind = b.column("slice").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (np.diff(which) != 0) | (kind[1:] != kind[:-1]), True])
            for s, e in zip(edges[:-1], edges[1:]):
                part = b.slice(s, e - s)
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims)
                if which[s] != at:
                    if queries and (not isinstance(held, list) or held):
                        yield answers(f, held, queries)[1]
                    at, held, queries, size = which[s], [], [], 0
                if not kind[s]:
                    held.append((x, ids))
                    continue
                lists = part.column("leaves")
                off, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
                off = off - off[0]
                seen = [flat[off[i] : off[i + 1]] for i in range(len(ids))]
                queries.append((ids, x, seen))
                size += x.nbytes + flat.nbytes
                if size >= BLOCK_BYTES and held:
                    held, out = answers(f, held, queries)
                    yield out
                    queries, size = [], 0
        if queries and (not isinstance(held, list) or held):
            yield answers(f, held, queries)[1]

    found = dealt.mapInArrow(rerank, OUT)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
