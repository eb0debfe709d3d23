"""Centroid clustering by dual-tree Lloyd, on integer vectors, exact.

1. The kept vectors are dealt into blocks of at most BLOCK_ROWS; each block's distinct vectors get a cover tree, built once
   by farthest-first traversal and written to the shared folder (the forest). Copies of a vector are one leaf, so a vector
   that is repeated without end costs one comparison a block.
2. Each round builds a cover tree over the centroids and sends it to all tasks. A task walks every block's tree and the
   centroids' tree together: a pair of nodes is dropped when no centroid of the one can be nearest to any vector of the
   other, by their centres' distance and their radii; else the node with the larger radius is split. Pairs of leaves are compared in whole numbers.
3. A task adds up its blocks' vectors by centroid, so a round shuffles at most k rows a task; the driver holds k centroids.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import saved

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a cover tree at most. Its building compares each with each.
BLOCK_ROWS = 1024
#: Largest component in magnitude: squared distances of 64 components stay below 2^63.
LARGEST = 1 << 27
#: Distances are doubles with relative errors around 1e-14; bounds are loosened by far more.
SLACK = 1e-9
#: Pairs whose distances are computed at once.
PAIRS = 16_384


def _distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i of a and j of b."""
    out = np.empty(len(i))
    for low in range(0, len(i), PAIRS):
        gap = a[i[low : low + PAIRS]] - b[j[low : low + PAIRS]]
        out[low : low + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(out)


class CoverTree:
    """A cover tree over distinct points. Level i's centres are more than 2^i apart and every point lies within 2^i of one;
    a centre stays one on all lower levels.

    Nodes are numbered from the root on, children of a node one after the other: `centre` (a point), `radius` (to the
    farthest point below), `first` and `count` (children; none: a leaf, which is its centre alone).
    """

    def __init__(self, points: np.ndarray, centre: np.ndarray, radius: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.points, self.centre, self.radius, self.first, self.count = points, centre, radius, first, count
        self.floats = points.astype(np.float64)

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        n, x = len(points), points.astype(np.float64)
        # farthest first: the centres of every level are a prefix of this order
        order, level, up = [0], [0], [-1]
        near, owner = np.sqrt(((x - x[0]) ** 2).sum(1)), np.zeros(n, np.int64)
        near[0] = -1.0
        history = []
        for _ in range(1, n):
            p = int(near.argmax())
            i = int(np.ceil(np.log2(near[p]))) - 1
            if history and level[-1] != i or not history:
                # the first point of a level: the centres so far are all of the next higher one
                history.append(owner.copy())
            order.append(p)
            level.append(i)
            up.append(int(history[-1][p]))
            gap = x - x[p]
            away = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            closer = away < near
            near[closer], owner[closer] = away[closer], p
            near[p] = -1.0
        children: dict[int, dict[int, list[int]]] = {}
        for p, i, parent in zip(order[1:], level[1:], up[1:], strict=True):
            children.setdefault(parent, {}).setdefault(i, []).append(p)
        # a node is a centre with those of its levels of children that are still to come, highest first
        steps = {p: sorted(by.items(), reverse=True) for p, by in children.items()}
        centre, first, count, parents, queue = [0], [], [], [-1], [(0, 0)]
        for at, (p, step) in enumerate(queue):
            mine = steps.get(p, [])
            below = [(q, 0) for q in mine[step][1]] + [(p, step + 1)] if step < len(mine) else []
            first.append(len(queue))
            count.append(len(below))
            queue.extend(below)
            centre += [q for q, _ in below]
            parents += [at] * len(below)
        centre, count, parents = np.array(centre), np.array(count), np.array(parents)
        radius = np.zeros(len(centre))
        now = np.flatnonzero(count == 0)
        own = centre[now]
        while True:
            alive = parents[now] >= 0
            now, own = parents[now[alive]], own[alive]
            if not len(now):
                break
            np.maximum.at(radius, now, _distances(x, centre[now], x, own))
        return cls(points, centre, radius, np.array(first), count)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, centre=self.centre, radius=self.radius, first=self.first, count=self.count)
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> CoverTree:
        with np.load(io.BytesIO(raw), allow_pickle=False) as found:
            return cls(*(found[name] for name in ("points", "centre", "radius", "first", "count")))

    def split(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of `nodes`, and for each the place of its parent in `nodes`."""
        count = self.count[nodes]
        place = np.repeat(np.arange(len(nodes)), count)
        within = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        return self.first[nodes][place] + within, place


def nearest(vectors: CoverTree, centroids: CoverTree, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's nearest centroid by `number` (of equal distances the smallest), the squared distance, and how many pairs
    of nodes were looked at."""
    best = np.full(len(vectors.centre), np.inf)
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    seen = 0
    while len(v):
        seen += len(v)
        away = _distances(vectors.floats, vectors.centre[v], centroids.floats, centroids.centre[c])
        rv, rc = vectors.radius[v], centroids.radius[c]
        np.minimum.at(best, v, away + rv)
        keep = away - rv - rc <= best[v] + SLACK * (away + rv + rc + best[v])
        v, c, rv, rc = v[keep], c[keep], rv[keep], rc[keep]
        leaf_v, leaf_c = vectors.count[v] == 0, centroids.count[c] == 0
        done = leaf_v & leaf_c
        leaves.append((v[done], c[done]))
        by_v = ~leaf_v & (leaf_c | (rv >= rc))
        by_c = ~done & ~by_v
        below, place = vectors.split(v[by_v])
        np.minimum.at(best, below, best[v[by_v]][place])
        lower, at = centroids.split(c[by_c])
        v, c = np.concatenate([below, v[by_c][at]]), np.concatenate([c[by_v][place], lower])
    v = vectors.centre[np.concatenate([x for x, _ in leaves])]
    c = centroids.centre[np.concatenate([x for _, x in leaves])]
    squared = np.empty(len(v), np.int64)
    for low in range(0, len(v), PAIRS):
        gap = vectors.points[v[low : low + PAIRS]] - centroids.points[c[low : low + PAIRS]]
        squared[low : low + PAIRS] = (gap * gap).sum(1)
    named = number[c]
    order = np.lexsort((named, squared, v))
    taken = order[np.concatenate([[True], v[order][1:] != v[order][:-1]])]
    return named[taken], squared[taken], seen


def centroid_tree(centroids: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    """The tree over the distinct centroids and the smallest number of each."""
    points, first = np.unique(centroids, axis=0, return_index=True)
    return CoverTree.build(points), first


def _integers(column: pa.Array, components: int, scale: int) -> np.ndarray:
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(column), components)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling: squared distances would not fit 64 bits")
    return values.astype(np.int64)


def _plant(start: np.ndarray, components: int, scale: int, block_rows: int):
    """Blocks of a batch's vectors, those near the same starting centroid together, with their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _integers(batch.column(1), components, scale)
            # near vectors share a tree; results don't depend on it
            floats, heads = whole.astype(np.float64), start.astype(np.float64)
            order = np.argsort(((heads * heads).sum(1) - 2 * floats @ heads.T).argmin(1), kind="stable")
            for low in range(0, len(order), block_rows):
                mine = order[low : low + block_rows]
                points, owner, weight = np.unique(whole[mine], axis=0, return_inverse=True, return_counts=True)
                ids = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), batch.column(0).take(pa.array(mine)))
                owners = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), pa.array(owner.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, owners, pa.array([weight.astype(np.int64).tobytes()], pa.binary()), pa.array([CoverTree.build(points).packed()], pa.binary())], names=["ids", "owners", "weights", "tree"])

    return run


def _add_up(model):
    """(cluster, n, sums) of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number, k = model.value
        n, sums = np.zeros(k, np.int64), np.zeros((k, tree.points.shape[1]), np.int64)
        for batch in batches:
            for raw, weights in zip(batch.column(0), batch.column(1), strict=True):
                block, weight = CoverTree.unpacked(raw.as_py()), np.frombuffer(weights.as_py(), np.int64)
                cluster, _, _ = nearest(block, tree, number)
                np.add.at(n, cluster, weight)
                np.add.at(sums, cluster, block.points * weight[:, None])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assign(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number, _ = model.value
        for batch in batches:
            for ids, owners, raw in zip(*batch.columns, strict=True):
                cluster, squared, _ = nearest(CoverTree.unpacked(raw.as_py()), tree, number)
                owner = owners.values.to_numpy()
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster[owner].astype(np.int32)), pa.array(squared[owner])], names=["id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `components` finite numbers; others, nulls among them, have no row. Fewer than k vectors
    give as many centroids; none give no rows. Repeated rows each get a row and each weigh in the means. Of equal
    centroids the smaller number takes all vectors, the others stay where they are. Starting centroids are those with the smallest sha256
    of `seed:id`, of equal ids the smaller vector; ids that are null come last. A component beyond 2^27 after scaling is
    refused. Other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{vector}`")
    fine = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(f"`{id}`").alias("id"), x.alias("v")).filter(F.coalesce(fine, F.lit(False)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    heads = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").toArrow()
    id_type = kept.schema["id"].dataType.simpleString()
    if not heads.num_rows:
        return spark.createDataFrame([], f"`{id}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = _integers(heads.column(0).combine_chunks(), components, scale)
    forest, _ = saved(kept.mapInArrow(_plant(centroids, components, scale, block_rows), f"ids array<{id_type}>, owners array<int>, weights binary, tree binary"), "forest")
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((*centroid_tree(centroids), len(centroids)))
        parts = forest.select("tree", "weights").mapInArrow(_add_up(model), "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(components)]).alias("sums"))
        for row in total.collect():
            centroids[row.cluster] = np.array(row.sums, np.int64) // row.n
        model.unpersist()
    model = spark.sparkContext.broadcast((*centroid_tree(centroids), len(centroids)))
    found, _ = saved(forest.select("ids", "owners", "tree").mapInArrow(_assign(model), f"id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.withColumnRenamed("id", id).join(F.broadcast(facts), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
