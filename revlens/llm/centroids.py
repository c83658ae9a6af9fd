"""Centroid clustering of integer vectors, with expressions of the JVM alone.

Components become whole numbers, so every sum, mean and distance is exact and a rerun or
another number of tasks gives the same clusters. A round is one job: each row's squared
distances to the centroids, which stand in the plan as literal arrays, are ``zip_with``
and ``aggregate``; the least (distance, number) pair of an ``array_min`` is its cluster;
and one aggregation sums the components by column, combined in each task before its few
rows are shuffled. What the driver holds is the centroids: clusters x components whole
numbers, whatever the table's size.

Defined results: vectors that are null, of another length or with a null or non-finite
component take no part. Ties go to the smaller number. Repeated rows count each; of start
candidates with one hash, as rows with one id have it, the smaller vector comes first, and
a null id has no hash and comes last. With fewer vectors than clusters there are as many
clusters as vectors, and with none no rows. An empty cluster keeps its centroid. A distance
or sum beyond 64 bits stops the job with Spark's overflow error instead of wrapping: with 64
components that needs values above a million. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.tables import stored

CLUSTERS, ROUNDS, LENGTH, SCALE = 40, 5, 64, 256


def whole_vectors(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, with floor(scale x component) as long."""
    x = F.col("embedding").cast("array<double>")
    # A comparison with infinity is false for NaN as well, since Spark holds NaN to be the largest.
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    kept = vectors.where((F.size("embedding") == length) & finite)
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: str = "2") -> list[list[int]]:
    """The vectors with the least SHA-256 of ``seed:vec_id``."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(drawn.alias("drawn"), "v").orderBy(F.col("drawn").asc_nulls_last(), "v").limit(clusters)
    return [list(r.v) for r in rows.collect()]


def _long_array(values: list[int]) -> Column:
    # One parsed text; a column object for each of some thousand numbers would take seconds a round.
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def nearest_centroid(v: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, number) of the nearest centroid."""
    def squared(a: Column, b: Column) -> Column:
        return (a - b) * (a - b)

    def distance(c: list[int]) -> Column:
        return F.aggregate(F.zip_with(v, _long_array(c), squared), F.lit(0).cast("long"), lambda total, d: total + d)

    return F.array_min(F.array(*(F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids))))


def assigned(whole: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``whole`` with cluster and distance."""
    near = whole.withColumn("_near", nearest_centroid(F.col("v"), centroids))
    return near.select(*whole.columns, F.col("_near.cluster").alias("cluster"), F.col("_near.distance").alias("distance"))


def moved(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each non-empty cluster's centroid replaced by the floor of its vectors' mean."""
    length = len(centroids[0])
    sums = assigned(whole, centroids).groupBy("cluster").agg(
        F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(length)))
    new = list(centroids)
    for r in sums.collect():  # one row a cluster
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(length)]
    return new


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH,
                    scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    whole = stored(whole_vectors(vectors, length, scale))
    centroids = first_centroids(whole, clusters)
    if not centroids:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    return assigned(whole, centroids).drop("v"), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_report(vectors: DataFrame, **parameters) -> DataFrame:
    """``cluster_vectors`` with the summed distances of the row's cluster and of all, and its centroid's digest."""
    rows, centroids = cluster_vectors(vectors, **parameters)
    rows = stored(rows)
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # one row a cluster
    by_cluster = {r.cluster: r.inertia for r in sums}
    total = F.lit(sum(by_cluster.values())).cast("long")
    # Literal arrays that the cluster's number picks from, so no join is needed.
    own = [by_cluster.get(i, 0) for i in range(len(centroids))] or [0]
    digests = F.array(*(F.lit(centroid_digest(c)) for c in centroids or [[]]))
    at = F.col("cluster") + 1
    return rows.select("vec_id", "cluster", "distance", F.element_at(_long_array(own), at).alias("cluster_inertia"),
                       total.alias("inertia"), F.element_at(digests, at).alias("centroid_sha256"))
