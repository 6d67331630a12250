"""Centroid clustering by Lloyd's rounds on integers, with the bounds of Elkan.

Each vector carries an upper bound of the distance to its centroid and a lower bound
of the distance to every centroid, in a table that is written each round. A moved
centroid loosens them by its way, and half the distance between two centroids rules
one of them out. Distances that are calculated are exact integers. Bounds are rounded
outward and a centroid is ruled out only if it is surely farther, so ties are seen.
A round is one pass over the table and one over vectors and clusters for the sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.llm.shared import Scratch, tune

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components after scaling: squared distances of up to 64 of them fit 63 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<int>) of the vectors with dims components that are all finite numbers."""
    v = F.col(vector_col)
    whole = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))

    def scaled(x):
        x = F.floor(scale * x.cast("double"))
        return F.when(F.abs(x) > LARGEST, F.raise_error(F.lit(f"a component times {scale} is over {LARGEST}"))).otherwise(x).cast("int")

    return vectors.where(v.isNotNull() & whole).select(F.col(id_col).alias("id"), F.transform(v, scaled).alias("vec"))


def up(x):
    return np.nextafter(x, np.inf)


def down(x):
    return np.nextafter(x, -np.inf)


def single(x: np.ndarray, to: float) -> np.ndarray:
    """x in single precision, rounded towards to."""
    y = x.astype(np.float32)
    wrong = y < x if to > 0 else y > x
    return np.where(wrong, np.nextafter(y, np.float32(to)), y)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def nearest(vec: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, distances=squared) -> None:
    """Moves each vector to its nearest centroid, the smaller number among equals, and tightens its bounds, in place. The bounds must hold for these centroids."""
    k = len(centroids)
    half = np.full((k, k), np.inf)
    for j in range(k):
        other = np.arange(k) != j
        half[j, other] = down(np.sqrt(squared(centroids[other], centroids[j]).astype(float))) / 2
    todo = np.flatnonzero(upper >= half.min(axis=1)[cluster])
    if not len(todo):
        return
    x, a, low = vec[todo], cluster[todo], lower[todo]
    best = distances(x, centroids[a])
    u = up(np.sqrt(best.astype(float)))
    low[np.arange(len(a)), a] = down(np.sqrt(best.astype(float)))
    for j in range(k):
        m = np.flatnonzero((a != j) & (low[:, j] <= u) & (half[a, j] <= u))
        if len(m):
            d = distances(x[m], centroids[j])
            low[m, j] = down(np.sqrt(d.astype(float)))
            closer = (d < best[m]) | ((d == best[m]) & (j < a[m]))
            m, d = m[closer], d[closer]
            a[m], best[m], u[m] = j, d, up(np.sqrt(d.astype(float)))
    cluster[todo], upper[todo], lower[todo] = a, u, low


def assigned(centroids: np.ndarray, moved: np.ndarray | None, last: bool):
    """Arrow function: (id, vec, cluster, upper, lower) to the same after a round; (id, vec) where moved, the ways of the centroids, is None. The last one gives (id, cluster, distance)."""
    import pyarrow as pa

    k, dims = centroids.shape

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            flat = batch.column(1).flatten()
            vec = flat.to_numpy().reshape(n, dims).astype(np.int64)
            if moved is None:
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                cluster = batch.column(2).to_numpy().astype(np.int64)
                upper = up(batch.column(3).to_numpy().astype(float) + moved[cluster])
                lower = np.maximum(down(batch.column(4).flatten().to_numpy().astype(float).reshape(n, k) - moved), 0)
            nearest(vec, cluster, upper, lower, centroids)
            group = pa.array(cluster, pa.int32())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), group, pa.array(squared(vec, centroids[cluster]))], ["id", "cluster", "distance"])
            else:
                bounds = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(single(lower, -np.inf).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), group, pa.array(single(upper, np.inf)), bounds], ["id", "vec", "cluster", "upper", "lower"])

    return run


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Clusters vectors of dims integers floor(scale * component): a row for each vector kept, (id, cluster, distance, cluster_inertia, inertia, centroid).

    The first centroids are the vectors whose ids, after ``seed:``, have the least
    sha256; of equal ids the lesser vector comes first. In each round every vector goes to
    its nearest centroid (the smaller number among equals), then each centroid with
    vectors is replaced by the floor of their mean. Vectors are assigned once more at the
    end; distance is squared, and summed over the cluster and over all. centroid is the
    last one's components.
    Null vectors, those of another length and those with a null, NaN or infinite component
    aren't kept; a null id is hashed as empty text. Repeated rows count as often as they
    stand. With fewer vectors than clusters each is a first centroid; an empty table gives
    no rows. Other columns are not read. A component beyond LARGEST after scaling is an
    error, as its distances would not fit.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "centroids")
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = quantised(vectors, dims, scale, id_col, vector_col)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.orderBy(name, "vec").limit(clusters).select("vec").collect()
    result = f"id {kind}, cluster int, distance long"
    if not first:
        done = spark.createDataFrame([], result)
        return done.selectExpr("*", "0L as cluster_inertia", "0L as inertia", "array(0L) as centroid").withColumnRenamed("id", id_col)
    centroids, moved, state = np.array([r.vec for r in first], np.int64), None, kept
    for _ in range(rounds):
        before = state
        state = scratch.table(before.mapInArrow(assigned(centroids, moved, False), f"id {kind}, vec array<int>, cluster int, upper float, lower array<float>"))
        if moved is not None:
            scratch.drop(before)
        new = centroids.copy()
        for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(dims)]).collect():  # a row for each cluster
            new[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
        moved = up(np.sqrt(squared(new, centroids).astype(float)))
        centroids = new
    done = scratch.table(state.mapInArrow(assigned(centroids, moved, True), result))
    sums = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sorted(sums.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # a row for each cluster
