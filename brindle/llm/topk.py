"""Exact inner-product top-k by branch and bound over ball trees.

Candidates are dealt by space: a tree of at most ``LEAVES`` leaves is fitted on a bounded
sample, and each leaf with more rows than a shard holds is split again by a hash. A leaf's ball
is the centre of its sample and the distance of its farthest row. Each shard, of at most about
``SHARD`` vectors and ``SHARD_BYTES`` bytes, becomes a ball tree in one task.

A query travels only to shards whose ball can hold one of its results: for a query q the
scores there are <q, centre> + |q| radius at most. Within a shard, blocks of ``QUERIES`` take
the nodes of its tree in the order of that bound; a node is passed over once no query of the
block can better its current k-th score there, ties counted as better.

The current k-th score is shared in two ways. A block keeps it while it goes through the
tree, so what the first leaves give bounds all others. Before that, each query has met
the ``PILOT`` candidates of least hash, and takes the k-th score it found there along. It is
a bound from real candidates: nothing that belongs to the result is lost.

Vectors are integers. Scores are exact: products are taken in floating point where all
partial sums stay below 2^53, else with Python's integers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import bounded_batches, checkpointed

SHARD, SHARD_BYTES = 8192, 64 << 20
QUERIES = 512
#: Candidates that every query meets first; also the sample that leaves are fitted on.
PILOT = 2048
LEAVES = 256
LEAF = 128
_LONG = 2**63 - 1


def quantised(vector):
    """floor(256 * x) of each component as a double, null where the vector can't take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    numbers = F.transform(vector, lambda x: x.cast("double"))
    usable = vector.isNotNull() & ~F.exists(numbers, bad)
    return F.when(usable, F.transform(numbers, lambda x: F.floor(256 * x).cast("bigint")))


def _below(score: int) -> float:
    """The score as a double that is not above it."""
    near = float(score)
    return near if int(near) <= score else math.nextafter(near, -math.inf)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors, an Arrow array of lists, as rows of 64-bit integers, the shorter filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    if (sizes == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class BallTree:
    """A tree over the rows of ``points``; ``ids`` break ties, the smaller first.

    Rows are halved along the component of largest spread down to ``LEAF``. A ball's
    centre is the mean of its rows; bounds are widened by what floating point can lose.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points.astype(np.float64)
        self.whole = points
        self.nodes: list[tuple[int, int, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.order = np.arange(len(points))
        if len(points):
            self._build(0, len(points))
            self.points, self.ids = self.points[self.order], ids[self.order]
            self.whole = points[self.order]
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)
        self.largest = float(np.abs(self.points).max(initial=0))

    def _build(self, a: int, b: int) -> int:
        rows = self.points[self.order[a:b]]
        centre = rows.mean(axis=0)
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9))
        spread = rows.max(axis=0) - rows.min(axis=0)
        if b - a > LEAF and spread.max() > 0:
            axis = int(spread.argmax())
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], middle)]
            self.nodes[me] = (a, b, self._build(a, a + middle), self._build(a + middle, b))
        return me

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        """For each query up to ``k`` (score, id), best first, that reach ``floor``.

        A candidate whose id is the query's own is left out.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        kth = floor.copy()
        whole, queries = queries, queries.astype(np.float64)
        if not len(self.points) or not len(own):
            return best
        norms = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-9 * (1 + norms * (self.largest * np.sqrt(queries.shape[1]) + 1))
        exact = float(np.abs(queries).max(initial=0)) * self.largest * queries.shape[1] < 2**53
        asked = queries if exact else whole.astype(object)

        def bound(node, rows):
            return queries[rows] @ self.centre[node] + norms[rows] * self.radius[node] + slack[rows]

        every = np.arange(len(own))
        queue = [(-float(bound(0, every).max()), 0, every)]
        while queue:
            _, node, rows = heapq.heappop(queue)
            rows = rows[bound(node, rows) >= kth[rows]]
            if not len(rows):
                continue
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    upper = bound(child, rows)
                    live = upper >= kth[rows]
                    if live.any():
                        heapq.heappush(queue, (-float(upper[live].max()), child, rows[live]))
                continue
            self._leaf(a, b, own, asked, rows, k, exact, best, kth)
        return best

    def _leaf(self, a, b, own, asked, rows, k, exact, best, kth):
        points, ids = self.points[a:b] if exact else self.whole[a:b].astype(object), self.ids[a:b]
        scores = asked[rows] @ points.T
        reach = (scores >= kth[rows][:, None]).astype(bool) & (ids[None, :] != own[rows][:, None])
        for i, row in enumerate(rows.tolist()):
            hit = np.flatnonzero(reach[i])
            if not len(hit):
                continue
            if exact and len(hit) > k:
                # of equal scores the smaller ids: cut below the k-th score only
                least = np.partition(scores[i, hit], len(hit) - k)[len(hit) - k]
                hit = hit[scores[i, hit] >= least]
            found = [(-max(-_LONG - 1, min(_LONG, int(scores[i, h]))), int(ids[h])) for h in hit]
            best[row] = heapq.nsmallest(k, best[row] + found)
            if len(best[row]) == k:
                kth[row] = max(kth[row], _below(-best[row][-1][0]))


class Leaves:
    """A partition of space into at most ``most`` leaves of about as many of the sampled ``points``.

    Leaves are cut off along the component of largest spread; equal points share a leaf.
    """

    def __init__(self, points: np.ndarray, most: int):
        self.splits: list[tuple[int, float, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.root = self._build(points, most)
        self.centre = np.array(self.centres)

    def _build(self, points: np.ndarray, most: int) -> int:
        """The number of a split, or -1 less that of a leaf."""
        spread = points.max(axis=0) - points.min(axis=0) if points.size else np.zeros(1)
        if most < 2 or spread.max(initial=0) <= 0:
            self.centres.append(points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
            return -len(self.centres)
        axis = int(spread.argmax())
        values = np.sort(points[:, axis])
        at = values[len(values) * (most // 2) // most]
        at = at if at > values[0] else values[values > values[0]][0]
        me = len(self.splits)
        self.splits.append((axis, at, 0, 0))
        low = points[:, axis] < at
        sides = self._build(points[low], most // 2), self._build(points[~low], most - most // 2)
        self.splits[me] = (axis, at, *sides)
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, at, low, high = self.splits[node]
            under = points[rows, axis] < at
            todo += [(low, rows[under]), (high, rows[~under])]
        return out


def _placed(leaves: Leaves, width: int):
    """Of (id, v, q, hash): the same, the leaf and the distance from its centre."""

    def rows(batches):
        for batch in batches:
            points = _matrix(batch.column("v"), width).astype(np.float64)
            leaf = leaves.of(points)
            far = np.sqrt(((points - leaves.centre[leaf]) ** 2).sum(axis=1))
            yield pa.record_batch(
                [*batch.columns, pa.array(leaf), pa.array(far)], names=[*batch.schema.names, "leaf", "far"]
            )

    return rows


def _sent(k: int, ids: list[int], points: np.ndarray, leaves: Leaves, radius: np.ndarray, base: np.ndarray, largest: float):
    """Of (id, v) of queries: a row (shard, query, id, v, floor) for each shard that may hold a result.

    ids, points: the pilot candidates. base: the first shard of each leaf, and the number of shards.
    """

    def rows(batches):
        tree = BallTree(np.array(ids, dtype=np.int64), points)
        width = points.shape[1]
        for batch in batches:
            asked = _matrix(batch.column("v"), width)
            best = tree.search(batch.column("id").to_numpy(), asked, k, np.full(len(asked), -np.inf))
            floor = np.array([_below(-b[-1][0]) if len(b) == k else -np.inf for b in best])
            asked = asked.astype(np.float64)
            norms = np.sqrt((asked**2).sum(axis=1))
            slack = 1e-9 * (1 + norms * (largest * np.sqrt(width) + 1))
            upper = asked @ leaves.centre.T + norms[:, None] * radius + slack[:, None]
            query, leaf = np.nonzero((upper >= floor[:, None]) & (base[1:] > base[:-1]))
            for a in range(0, len(query), 8192):
                some, of = query[a : a + 8192], leaf[a : a + 8192]
                many = base[of + 1] - base[of]
                some = np.repeat(some, many)
                shard = np.repeat(base[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
                take = pa.array(some)
                yield pa.record_batch(
                    [pa.array(shard.astype(np.int32)), pa.array(np.ones(len(some), dtype=bool)),
                     batch.column("id").take(take), batch.column("v").take(take), pa.array(floor[some])],
                    names=["shard", "query", "id", "v", "floor"],
                )

    return rows


def _searched(k: int, width: int, block: int):
    """Of (shard, query, id, v, floor) sorted by shard, candidates before queries: the results of every query there."""

    def rows(batches):
        shard, ids, points, tree = None, [], [], None
        for batch in batches:
            shards, asking = batch.column("shard").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asking[1:] != asking[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, ids, points, tree = shards[a], [], [], None
                own = batch.column("id").slice(a, b - a).to_numpy()
                vectors = _matrix(batch.column("v").slice(a, b - a), width)
                if not asking[a]:
                    ids.append(own)
                    points.append(vectors)
                    continue
                if tree is None:
                    every = np.concatenate(points) if points else np.zeros((0, width), dtype=np.int64)
                    tree = BallTree(np.concatenate([*ids, np.zeros(0, dtype=np.int64)]).astype(np.int64), every)
                    ids, points = [], []
                floors = batch.column("floor").slice(a, b - a).to_numpy()
                for c in range(0, b - a, block):
                    part = slice(c, c + block)
                    yield _results(own[part].tolist(), tree.search(own[part], vectors[part], k, floors[part]))

    return rows


def _results(own, best):
    out = [(q, i, -x) for q, found in zip(own, best) for x, i in found]
    columns = zip(*out) if out else ((), (), ())
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame, queries: Column, k: int, id: str = "vec_id", vector: str = "embedding",
    shard: int = SHARD, block: int = QUERIES, pilot: int = PILOT,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` best candidates of each query.

    ``queries`` is a condition on ``vectors``; every row but the query's own is a
    candidate. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; empty vectors score 0. Shorter vectors are filled up
    with zeros. Components beyond 64 bits count as the nearest 64-bit value, and so do
    scores. Rows with the same id and vector count once; a query never meets its own
    id. Equal scores go by the smaller id. Fewer candidates: fewer ranks. No queries or
    no other rows: no rows. Other columns are not looked at.
    """
    bounded_batches(vectors.sparkSession)
    usable = checkpointed(
        vectors.where(F.col(id).isNotNull())
        .select(
            F.col(id).cast("bigint").alias("id"), quantised(F.col(vector)).alias("v"),
            F.coalesce(queries, F.lit(False)).cast("int").alias("q"),
        )
        .where("v is not null")
        .groupBy("id", "v").agg(F.max("q").alias("q"))
        .withColumn("hash", F.xxhash64("id", "v"))
    )
    far = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    n, width, largest = usable.agg(
        F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(far), F.lit(0.0))
    ).first()
    shard = max(1, min(shard, SHARD_BYTES // (8 * max(width, 1))))
    # at most ``pilot`` vectors
    first = usable.orderBy("hash", "id").limit(pilot).select("id", "v").toArrow().combine_chunks()
    points = _matrix(pa.array(first["v"].to_pylist(), pa.list_(pa.int64())), width)
    ids = first["id"].to_pylist()
    # a leaf is fitted on four points at least
    leaves = Leaves(points.astype(np.float64), max(1, min(LEAVES, -(-n // shard), len(ids) // 4)))
    placed = usable.mapInArrow(
        _placed(leaves, width), "id bigint, v array<bigint>, q int, hash bigint, leaf bigint, far double"
    )
    radius, many = np.zeros(len(leaves.centre)), np.zeros(len(leaves.centre), dtype=np.int64)
    # one row per leaf
    for row in placed.groupBy("leaf").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[row.leaf], many[row.leaf] = row.far * (1 + 1e-9), -(-row.n // shard)
    base = np.concatenate(([0], np.cumsum(many)))
    sent = _sent(k, ids, points, leaves, radius, base, largest)
    shape = "shard int, query boolean, id bigint, v array<bigint>, floor double"
    wanted = usable.where("q = 1").select("id", "v").mapInArrow(sent, shape)
    of = F.array(*[F.lit(x) for x in base.tolist()])
    part = F.pmod(F.shiftright("hash", 8), of[F.col("leaf").cast("int") + 1] - of[F.col("leaf").cast("int")])
    candidates = placed.select(
        (of[F.col("leaf").cast("int")] + part).cast("int").alias("shard"), F.lit(False).alias("query"), "id", "v",
        F.lit(0.0).alias("floor"),
    )
    shards = max(1, int(base[-1]))
    found = (
        candidates.unionByName(wanted)
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", "query")
        .mapInArrow(_searched(k, width, block), "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
