"""Nearest neighbours by inner product with a forest of random-projection trees.

Trees are fitted on about ``SAMPLE`` vectors (at most twice that) drawn by the hash of id and vector: a node's hyperplane lies
between two random members, at the median projection.  Every vector is indexed under
its leaf in each tree.  A query walks all trees through one priority queue ordered by its
margin to the hyperplanes and takes leaves until its effort is spent.  Leaf candidates
are scored on the original vectors in double precision.

Inner product becomes distance by one more coordinate that gives all vectors the same
length (queries have zero there).  The effort, leaves taken by a query, is the smallest
for which queries drawn from the sample find ``RECALL`` of their neighbours within the
sample (compared with brute force), or more where they hold less than k candidates of the
sample.  The k-th best score of the sample's vectors in the leaves that a query takes
bounds its k-th best of all candidates there from below, so candidates below it are not
passed on, and none of the k nearest found is lost.

A leaf is dealt in chunks of about ``CHUNK`` vectors, and the queries of a leaf meet each
chunk in one group, in blocks: no group holds more than a chunk, and queries of one
leaf are themselves split by ``CHUNK``.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; nor do rows without an
id.  Repeated rows count once.  A vec_id with several vectors is dealt with as that many
candidates of which the best counts: bounds and cuts are taken over distinct ids, never
over rows.  As a query it asks with the least of its vectors.  Ties go to the smaller vec_id.  Empty tables give empty results.  Only
vec_id and embedding are read.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.base import drawn, stage

SAMPLE = 8000
TREES = 12
LEAF = 48
NEIGHBOURS = 20
RECALL = 0.96
TRIALS = 64
CHUNK = 4096
SEED = 11


def usable(rows):
    """vec_id and v (array of double) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    some = F.exists(vector, lambda x: x != 0)
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    good = good.filter(finite & some).select("vec_id", vector.alias("v"))
    width = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("v") == (width["n"] if width else 0))


class Forest:
    """Trees as arrays: hyperplanes, offsets and children (negative: a leaf)."""

    def __init__(self, sample, longest, trees=TREES, leaf=LEAF, seed=SEED):
        self.longest, self.leaf = longest, leaf
        draw = np.random.default_rng(seed)
        self.planes, self.offsets, self.children, self.roots = [], [], [], []
        points = self.lifted(sample)
        for _ in range(trees if len(points) else 0):
            self.roots.append(self._grow(points, np.arange(len(points)), draw))
        self.planes = np.array(self.planes).reshape(len(self.offsets), points.shape[1])
        self.offsets = np.array(self.offsets)

    def lifted(self, vectors):
        """Vectors with the coordinate that makes them equally long."""
        if not len(vectors):
            return np.zeros((0, 1))
        room = np.maximum(self.longest**2 - (vectors**2).sum(1), 0)
        return np.column_stack([vectors, np.sqrt(room)])

    def _grow(self, points, members, draw):
        node = len(self.offsets)
        self.planes.append(np.zeros(points.shape[1]))
        self.offsets.append(0.0)
        self.children.append((-1, -1))
        if len(members) > self.leaf:
            a, b = points[draw.choice(members, 2, replace=False)]
            plane = a - b
            size = np.linalg.norm(plane)
            if size > 0:
                along = points[members] @ (plane / size)
                middle = np.median(along)
                low = along <= middle
                if 0 < low.sum() < len(low):
                    self.planes[node], self.offsets[node] = plane / size, middle
                    self.children[node] = (
                        self._grow(points, members[low], draw),
                        self._grow(points, members[~low], draw),
                    )
        return node

    def leaves(self, vectors):
        """The leaf of each vector in each tree: (vectors, trees)."""
        sides = self.lifted(vectors) @ self.planes.T > self.offsets
        children, rows = np.array(self.children), np.arange(len(vectors))
        out = []
        for root in self.roots:
            at = np.full(len(vectors), root)
            while True:
                below = children[at, sides[rows, at].astype(int)]
                if (below < 0).all():
                    break
                at = np.where(below < 0, at, below)
            out.append(at)
        return np.array(out).T.reshape(len(vectors), len(self.roots))

    def probes(self, queries):
        """For each query a generator of leaves, best first, over all trees at once."""
        flat = np.column_stack([queries, np.zeros(len(queries))])
        for margins in (flat @ self.planes.T - self.offsets).tolist():
            yield self._walk(margins)

    def _walk(self, margins):
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        while queue:
            cost, node = heapq.heappop(queue)
            low, high = self.children[node]
            if low < 0:
                yield node
                continue
            margin = margins[node]
            near, far = (high, low) if margin > 0 else (low, high)
            heapq.heappush(queue, (max(cost, -abs(margin)), near))
            heapq.heappush(queue, (max(cost, abs(margin)), far))


def best_of_ids(scores, ids):
    """The place of the best score of each distinct id, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])]


def calibrate(forest, sample, k=NEIGHBOURS, recall=RECALL, trials=TRIALS, ids=None):
    """Leaves a query must take to find ``recall`` of its neighbours in the sample."""
    ids = np.arange(len(sample)) if ids is None else ids
    if len(np.unique(ids)) <= k + 1:
        return len(forest.offsets)
    at = np.arange(0, len(sample), max(1, len(sample) // trials))
    queries, leaves = sample[at], forest.leaves(sample)
    scores = queries @ sample.T
    others = [np.flatnonzero(ids != ids[i]) for i in at]
    truth = [o[best_of_ids(row[o], ids[o])[:k]] for o, row in zip(others, scores, strict=True)]
    needed = []
    for best, order in zip(truth, forest.probes(queries), strict=True):
        turn = {leaf: n + 1 for n, leaf in enumerate(order)}
        needed.extend(min(turn[leaf] for leaf in leaves[b]) for b in best)
    return int(np.quantile(needed, recall))


def fit(rows, sample=SAMPLE, k=NEIGHBOURS):
    """(forest, effort, sample matrix, sample ids) for the usable vectors."""
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    longest = rows.agg(F.sqrt(F.max(squares))).first()[0] or 0.0
    taken = drawn(rows, sample, "vec_id", "v").sort("vec_id", "v").collect()
    ids = np.array([row["vec_id"] for row in taken], np.int64)
    matrix = np.array([row["v"] for row in taken], float).reshape(len(taken), -1 if taken else 1)
    forest = Forest(matrix, longest)
    return forest, calibrate(forest, matrix, k, ids=ids), matrix, ids


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def exact(queries, candidates):
    """Inner products in double precision, the same for the same pair wherever it stands."""
    return np.array([(candidates * q).sum(axis=1) for q in queries]).reshape(len(queries), len(candidates))


def _index(shared):
    def run(batches):
        for batch in batches:
            forest = shared.value[0]
            leaves = forest.leaves(_matrix(batch.column("v")))
            trees = leaves.shape[1]
            at = np.repeat(np.arange(len(leaves)), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves.reshape(-1).astype(np.int64)), batch.column("vec_id").take(at), batch.column("v").take(at)],
                names=["leaf", "vec_id", "v"],
            )

    return run


def _search(shared, k):
    def run(batches):
        for batch in batches:
            forest, effort, sample, ids = shared.value
            members = forest.leaves(sample)
            queries, own = _matrix(batch.column("v")), batch.column("query_id").to_numpy()
            for at, leaves in enumerate(forest.probes(queries)):
                taken = np.zeros(len(forest.offsets), bool)
                found = []
                near = np.zeros(0, int)
                for leaf in leaves:
                    found.append(leaf)
                    taken[leaf] = True
                    if len(found) >= effort:
                        near = np.flatnonzero(taken[members].any(axis=1) & (ids != own[at]))
                        if len(np.unique(ids[near])) >= k:
                            break
                scores = exact(queries[at : at + 1], sample[near])[0]
                scores = scores[best_of_ids(scores, ids[near])]
                floor = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(found, np.int64)),
                        pa.array(np.full(n, own[at])),
                        pa.array(np.full(n, floor)),
                        batch.column("v").take(pa.array(np.full(n, at))),
                    ],
                    names=["leaf", "query_id", "floor", "v"],
                )

    return run


def _score(k):
    """Candidates of one chunk for the queries that reach its leaf."""

    def run(left, right):
        out = [[], [], []]
        vectors, ids = _matrix(left.column("v").combine_chunks()), left.column("vec_id").to_numpy()
        queries, own = _matrix(right.column("v").combine_chunks()), right.column("query_id").to_numpy()
        floors = right.column("floor").to_numpy()
        for at in range(len(own) if len(ids) else 0):
            rough = vectors @ queries[at]
            near = np.flatnonzero((rough >= floors[at] - 1e-9 * max(1.0, abs(floors[at]))) & (ids != own[at]))
            if len(near) > 4 * k:
                firsts = best_of_ids(rough[near], ids[near])[:k]
                if len(firsts) == k:
                    least = rough[near][firsts[-1]]
                    near = near[rough[near] >= least - 1e-9 * max(1.0, abs(least))]
            scores = exact(queries[at : at + 1], vectors[near])[0]
            best = best_of_ids(scores, ids[near])[:k]
            out[0].append(np.full(len(best), own[at]))
            out[1].append(ids[near][best])
            out[2].append(scores[best])
        kinds = (np.int64, np.int64, float)
        arrays = [pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t)) for x, t in zip(out, kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def search(vectors, queries, k=NEIGHBOURS):
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and v (see ``usable``), ``queries`` some of its rows.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors.select("vec_id", "v").distinct(), "vectors")
    model = fit(vectors, k=k)
    shared = spark.sparkContext.broadcast(model)
    index = stage(vectors.mapInArrow(_index(shared), "leaf long, vec_id long, v array<double>"), "forest-index")
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    probes = stage(
        asked.mapInArrow(_search(shared, k), "leaf long, query_id long, floor double, v array<double>"),
        "forest-probes",
    )
    held = index.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    wanted = probes.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    # one row a leaf of the fitted forest: bounded by its sample
    plan = F.broadcast(held.join(wanted, "leaf"))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        index.join(plan, "leaf")
        .withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int"))
        .select("leaf", "chunk", copies("blocks").alias("block"), "vec_id", "v")
    )
    right = (
        probes.join(plan, "leaf")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        .select("leaf", copies("chunks").alias("chunk"), "block", "query_id", "floor", "v")
    )
    group = ["leaf", "chunk", "block"]
    found = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInArrow(_score(k), "query_id long, vec_id long, score double")
    )
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
