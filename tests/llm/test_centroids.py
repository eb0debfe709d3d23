from __future__ import annotations

import hashlib

import numpy as np
import pytest

from textquarry.llm.centroids import CoverTree, centroid_tree, clustered, nearest

VECTORS = "vec_id long, embedding array<float>, id int, cluster int, v string"


def brute(rows, k, rounds, scale=256, seed=2):
    """Every vector against every centroid, in whole numbers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in hashed[:k]]

    def assign():
        out = []
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(centroids))
            out.append((i, v, c, d))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for _, v, own, _ in found if own == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    total = sum(d for *_, d in found)
    return sorted((str(i), c, d, sum(x for _, _, own, x in found if own == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, _, c, d in found)


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_tree_keeps_its_invariants():
    points = np.unique(np.random.default_rng(3).integers(-50, 50, (300, 5)), axis=0)
    tree = CoverTree.unpacked(CoverTree.build(points).packed())
    leaves = np.flatnonzero(tree.count == 0)
    assert sorted(tree.centre[leaves]) == list(range(len(points)))  # every point is one leaf
    below = {n: {int(tree.centre[n])} for n in leaves}
    for n in reversed(range(len(tree.centre))):
        if tree.count[n]:
            children = range(tree.first[n], tree.first[n] + tree.count[n])
            assert tree.centre[n] in tree.centre[children]  # a centre stays one
            below[n] = set().union(*(below[c] for c in children))
        far = max(np.linalg.norm(tree.floats[p] - tree.floats[tree.centre[n]]) for p in below[n])
        assert far <= tree.radius[n] + 1e-9
    assert below[0] == set(range(len(points)))


def test_far_pairs_are_pruned_and_ties_go_to_the_smaller_number():
    random = np.random.default_rng(1)
    heads = random.integers(-1000, 1000, (40, 64))
    points = np.unique(np.concatenate([h + random.integers(-9, 9, (25, 64)) for h in heads]), axis=0)
    cluster, squared, seen = nearest(CoverTree.build(points), *centroid_tree(heads))
    full = ((points[:, None] - heads[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (squared == full.min(1)).all()
    assert seen < full.size / 5
    line = np.array([[0], [2], [4]])
    cluster, squared, _ = nearest(CoverTree.build(line), *centroid_tree(np.array([[3], [1], [3]])))
    assert cluster.tolist() == [1, 0, 0] and squared.tolist() == [1, 1, 1]


@pytest.mark.parametrize("block_rows", [1, 7, 1024])
def test_as_brute_force_on_odd_rows(spark, block_rows):
    random = np.random.default_rng(7)
    rows = [(i, [float(x) for x in random.normal(size=4).astype(np.float32)]) for i in range(120)]
    rows += [(200 + i, [0.5, -0.25, 0.0, 1.0]) for i in range(60)]  # a third are copies
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, [1.0, 1.0, 1.0, 1.0]), (None, None), (300, [1.0, None, 1.0, 1.0]), (301, [1.0, float("nan"), 1.0, 1.0]), (302, [float("inf"), 1.0, 1.0, 1.0]), (303, [1.0] * 3), (304, []), (305, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS).repartition(3)
    assert rows_of(clustered(df, k=6, rounds=3, components=4, block_rows=block_rows)) == brute(rows, 6, 3)


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1, 2, "x"), (2, [1.0, 2.0, 3.0, 4.0], 1, 2, "x")], VECTORS)
    got = clustered(few, components=4).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 2
    none = clustered(few.limit(0), components=4)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        clustered(spark.createDataFrame([(1, [1e9, 2.0, 3.0, 4.0], 1, 2, "x")], VECTORS), components=4).collect()
