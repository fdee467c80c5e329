"""Centroid clustering of integer vectors, in SQL expressions from end to end.

Components become integers, so every distance, sum and centroid is exact and the same on any partitioning. A round is one pass over the
vectors: `zip_with` and `aggregate` give the squared distance to each centroid, written into the plan as literal arrays; `array_min` over
(distance, number) picks the cluster; one aggregation sums each component by column, with partial sums before the shuffle, so that
a hot cluster or a vector that many rows share is a few rows by then. Only the new centroids (`clusters` rows of `dim` sums) reach the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from learnlens.llm.common import cut

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3


def _whole(vector: Column, dim: int, scale: int) -> Column:
    """The vector as whole numbers, floor(scale * x); null unless it has `dim` components, none null or non-finite."""
    fine = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def _literal(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{int(v)}L' for v in values)})")


def _distance(vector: Column, centroid: list[int]) -> Column:
    return F.aggregate(F.zip_with(vector, _literal(centroid), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, x: total + x)


def assigned(rows: DataFrame, centroids: list[list[int]], vector: str = "v") -> DataFrame:
    """`rows` with `best`, the struct (distance, cluster) of the nearest centroid; ties to the smaller number."""
    each = [F.struct(_distance(F.col(vector), c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]
    return rows.withColumn("best", F.array_min(F.array(*each)))


def moved(rows: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after one round: floors of the exact component means; an empty cluster's centroid stays."""
    # nan keys, null vectors and the like are gone by now; every vector has `dim` components.
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]
    found = assigned(rows, centroids).select(F.col("best.cluster").alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    out = list(centroids)
    for row in found:
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(dim)]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of `vectors` (vec_id, embedding; others are ignored).

    Kept are vectors of `dim` components, none null or non-finite; the rest is not returned. The first centroids are the kept vectors with the smallest sha256 of
    `<seed>:<vec_id>`, of rows alike in that the smallest vector; fewer rows give fewer clusters. Rows without vec_id come last in that order and are
    assigned like any other. Repeated rows count each. Empty tables give an empty result. Squared distances must fit 63 bits: components
    that are too large end in Spark's overflow error, not in a wrong sum.
    """
    vector = _whole(F.col("embedding").cast("array<double>"), dim, scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where("v is not null")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [list(r.v) for r in rows.orderBy(first.asc_nulls_last(), "v").limit(clusters).collect()]
    if not centroids:
        return rows.selectExpr("vec_id", "cast(null as int) cluster", *(f"cast(null as bigint) {c}" for c in ("distance", "cluster_inertia", "inertia")), "cast(null as string) centroid_sha256").limit(0)
    for _ in range(rounds):
        centroids = moved(rows, centroids, dim)
    done = cut(assigned(rows, centroids).select("vec_id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance")))
    spread = dict(done.groupBy("cluster").agg(F.sum("distance")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return done.select(
        "vec_id", "cluster", "distance", F.element_at(_literal([spread.get(k, 0) for k in range(len(centroids))]), at).alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"), F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"),
    )
