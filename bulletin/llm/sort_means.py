"""Centroid clustering by sort-means, in exact integers.

Each round sorts, for every centroid, the others by their distance from it.  A vector starts at the
centroid it had and goes along that order; it stops where a centroid is strictly further from the
old one than twice the vector's own distance to it, as no later one can be as near as the old one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Components up to this size give products and sums that doubles hold exactly, in up to 256 dimensions.
EXACT = 1 << 21
#: Squared distances of vectors of larger components than this would leave 64 bits.
MOST = 1 << 27
ASSIGNED = "vec_id long, v array<int>, cluster int, distance long"


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, the integers floor(scale * x), of vectors of ``dims`` finite components."""

    def whole(x: Column) -> Column:
        c = F.floor(x.cast("double") * scale)
        return F.when(F.abs(c) <= MOST, c.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))

    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where((F.size(vector_col) == dims) & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, whole).alias("v"))


def distances(points: np.ndarray, squares: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return squares + centroid @ centroid - 2 * (points @ centroid)


def nearest(points: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid (ties: the smallest number) and squared distance of each point, and how many distances it took.

    ``before`` is the centroid that each point had.
    """
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if most <= EXACT and points.shape[1] <= 256 else np.int64
    points, centroids = points.astype(kind), centroids.astype(kind)
    squares = np.einsum("ij,ij->i", points, points)
    between = np.stack([distances(centroids, np.einsum("ij,ij->i", centroids, centroids), c) for c in centroids])
    order = np.argsort(between, axis=1, kind="stable")
    clusters, found, taken = before.astype(np.int64), np.zeros(len(points), np.int64), len(points)
    for old in np.unique(before):
        at = np.flatnonzero(before == old)
        own = distances(points[at], squares[at], centroids[old])
        far_first = np.argsort(-own, kind="stable")
        at, own = at[far_first], own[far_first]
        group, group_squares, best, cluster = points[at], squares[at], own.copy(), np.full(len(at), old)
        for other in order[old]:
            # Distances are squared: twice a distance is four times as much.
            reach = np.searchsorted(-4 * own, -between[old, other], "right")
            if not reach:
                break
            if other == old:
                continue
            d = distances(group[:reach], group_squares[:reach], centroids[other])
            nearer = (d < best[:reach]) | ((d == best[:reach]) & (other < cluster[:reach]))
            best[:reach][nearer], cluster[:reach][nearer] = d[nearer], other
            taken += int(reach)
        clusters[at], found[at] = cluster, best
    return clusters, found, taken


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, v, cluster) with the nearest of the centroids and the squared distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            clusters, found, _ = nearest(points.astype(np.int64), batch.column("cluster").to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(clusters, pa.int32()), pa.array(found, pa.int64())],
                names=["vec_id", "v", "cluster", "distance"],
            )

    return rows.select("vec_id", "v", "cluster").mapInArrow(run, ASSIGNED)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors, as they were without any."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Assign each vector to one of ``k`` centroids that ``rounds`` rounds of sort-means give.

    One row per kept vector: ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``,
    ``inertia`` and ``centroid_sha256``.  Kept are vectors of exactly ``dims`` components, none null
    or non-finite; a component beyond 2**27 after scaling is an error, as distances would leave 64
    bits.  Centroids start as the kept vectors of smallest sha256 of ``seed:id`` (equal hashes, of
    repeated ids: the smaller vector first; null ids come last); with fewer vectors than ``k``
    there are fewer centroids.  Repeated rows count each, ties go to the smaller number, other
    columns are ignored and an empty table gives no rows.

    A round reads a table of the vectors with their last assignment and writes the next one, so
    nothing is computed twice; only k x dims sums come to the driver.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, id_col, vector_col, dims, scale).withColumn("cluster", F.lit(0))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        rows = stored(assigned(rows, centroids), "sort-means")
        centroids = moved(rows, centroids)
    rows = stored(assigned(rows, centroids), "sort-means")
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())
    of_cluster = [
        (i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.tolist())
        if i in inertia
    ]
    facts = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle(k: int = 40, rounds: int = 5) -> str:
    """Plain k-means in DuckDB: every vector against every centroid in each round."""
    parts = [
        """k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
    SELECT sha256('2:' || vec_id) AS h, v FROM k ORDER BY h LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT k.vec_id, k.v, c, list_dot_product(k.v, k.v) + list_dot_product(z.v, z.v) - 2 * list_dot_product(k.v, z.v) AS d
    FROM k, c{r} z) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT best.c AS c, i, floor(sum(v[i]) / count(*)) AS m FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s.v, z.v) AS v FROM c{r} z LEFT JOIN s{r} s USING (c))")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance,
       (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = best.c"""
    )


ORACLE = oracle()
