"""Centroid clustering against a plain version in whole numbers."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from revlens.llm import centroids

LENGTH, CLUSTERS, ROUNDS = 6, 5, 4
SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", 1) for i, v in rows], SCHEMA).repartition(3)


def drawn(n, seed=0):
    r = random.Random(seed)
    spots = [[r.uniform(-3, 3) for _ in range(LENGTH)] for _ in range(7)]
    return [(i, [float(f"{x + r.gauss(0, 0.4):.3f}") for x in r.choice(spots)]) for i in range(n)]


def brute(spark, rows):
    stored = [(r.vec_id, r.embedding) for r in vectors(spark, rows).collect()]  # components as 32-bit floats
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in stored
             if v is not None and len(v) == LENGTH and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in whole)
    means = [v for _, _, v in hashed[:CLUSTERS]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(means))

    for _ in range(ROUNDS):
        members = [[] for _ in means]
        for _, v in whole:
            members[nearest(v)[1]].append(v)
        means = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, means)]
    found = [(i, *nearest(v)) for i, v in whole]
    total = sum(d for _, d, _ in found)
    return sorted(((i, j, d, sum(e for _, e, k in found if k == j), total,
                    hashlib.sha256(",".join(map(str, means[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def report(spark, rows):
    got = centroids.cluster_report(vectors(spark, rows), clusters=CLUSTERS, rounds=ROUNDS, length=LENGTH)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_equals_a_plain_version(spark):
    rows = drawn(200)
    odd = [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7), (504, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
           (505, [float("nan")] + [0.0] * 5), (506, [float("inf")] + [0.0] * 5), (507, [0.0] * 5 + [float("-inf")]),
           (None, [0.5] * 6), (None, [0.25] * 6), rows[0], rows[0], (0, [9.0] * 6), (508, [0.0] * 6), (509, [-0.001] * 6)]
    got = report(spark, rows + odd)
    assert got == brute(spark, rows + odd)
    assert not {r[0] for r in got} & set(range(500, 508))


def test_ties_and_few_vectors(spark):
    same = [(i, [1.0] * LENGTH) for i in range(30)]  # all centroids equal: the first takes all, the others stay empty
    got = report(spark, same)
    assert got == brute(spark, same) and {r[1] for r in got} == {0}
    assert report(spark, drawn(3)) == brute(spark, drawn(3))


def test_no_vectors(spark):
    assert report(spark, []) == [] and report(spark, [(1, None)]) == []


def test_a_round_runs_in_the_jvm(spark):
    rows = spark.range(50).select(F.col("id").alias("vec_id"), F.array([F.sin(F.col("id") * i) for i in range(LENGTH)]).alias("embedding"))
    whole = centroids.whole_vectors(rows, LENGTH)
    plan = centroids.assigned(whole, [[1] * LENGTH, [2] * LENGTH])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Join", "Exchange"))
