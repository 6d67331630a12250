import hashlib
import math
import random

import numpy as np
import pytest

from surgeline.llm import centroids as C


def plain(rows, k=40, rounds=5, seed=2, dims=64, scale=256):
    """(id, cluster, distance, cluster_inertia, inertia, centroid) by whole distances."""
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if ok(v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]
    best = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [best(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [best(v) for _, v in kept]
    total = {j: sum(d for d, o in last if o == j) for _, j in last}
    return [(i, j, d, total[j], sum(total.values()), cents[j]) for (i, _), (d, j) in zip(kept, last)]


def same(got, want):
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_matches_whole_distances_with_ties_and_odd_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(3)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(80)] + [rows[5]] * 3 + [(None, [0.1, 0.2, 0.3]), (None, None), (7, []), (8, [1.0, None, 2.0]), (9, [1.0, float("nan"), 2.0]), (10, [float("inf"), 0.0, 0.0]), (11, [1.0, 2.0]), (12, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as cluster", "'z' as distance", "2 as id", "3 as vec").repartition(7)
    for k in (1, 2, 6, 300):
        same(C.cluster(df, clusters=k, dims=3).collect(), plain(rows, k, dims=3))


def test_matches_on_the_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    same(C.cluster(df).collect(), plain(rows))


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        out = C.cluster(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_a_component_that_does_not_fit_is_an_error(spark):
    with pytest.raises(Exception, match="a component times 256 is over"):
        C.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).count()


def test_bounds_hold_and_spare_most_distances():
    g = np.random.default_rng(3)
    homes = g.integers(-5000, 5000, (40, 16))
    vec = (homes[g.integers(0, 40, 3000)] + g.integers(-200, 200, (3000, 16))).astype(np.int64)
    cents = vec[:40].copy()
    cluster, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 40))
    done = []
    for turn in range(6):
        taken = []
        C.nearest(vec, cluster, upper, lower, cents, lambda a, b: (taken.append(len(a)), C.squared(a, b))[1])
        exact = ((vec[:, None] - cents[None]) ** 2).sum(2)
        assert (cluster == exact.argmin(1)).all()
        assert (upper**2 >= exact[np.arange(3000), cluster]).all() and (lower**2 <= exact).all()
        done.append(sum(taken))
        new = np.array([vec[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else cents[j] for j in range(40)])
        moved = C.up(np.sqrt(C.squared(new, cents).astype(float)))
        upper, lower, cents = C.up(C.single(upper, np.inf).astype(float) + moved[cluster]), np.maximum(C.down(C.single(lower, -np.inf).astype(float) - moved), 0), new
    assert done[0] < 0.7 * vec.shape[0] * 40 and done[-1] < 0.1 * vec.shape[0] * 40


def test_bounds_keep_ties_of_large_numbers():
    big = 1 << 26
    vec = np.array([[big - 1, 0], [0, 1], [-big, 7]], np.int64)
    cents = np.array([[big, 1], [big - 2, 1], [big - 2, -1], [-big, 8], [-big, 6]], np.int64)
    for start in range(5):
        cluster, upper, lower = np.full(3, start), np.full(3, np.inf), np.zeros((3, 5))
        for _ in range(3):
            C.nearest(vec, cluster, upper, lower, cents)
            assert cluster.tolist() == [0, 1, 3]
