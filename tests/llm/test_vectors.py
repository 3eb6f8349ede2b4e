"""Hard negatives and centroid clustering against brute force in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import centroids, hard_negatives, queries


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(scale * float(x)) for x in v]


def brute_negatives(rows, every=50):
    kept = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, floors(v, 256))
        for i, label, v in rows
        if i is not None and label is not None and usable(v)
    ]

    def product(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        scores = [(-product(v, w), j, m) for k, (j, m, w) in enumerate(kept) if k != n]
        for positive, j, _ in sorted(s for s in scores if s[2] == label)[:5]:
            p = -positive
            fits = sorted((s, k) for s, k, m in scores if m != label and 50 * p <= -100 * s <= 95 * p)
            out += [(i, j, rank, k, p, -s) for rank, (s, k) in enumerate(fits[:3], 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, _row string, block long"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def mined(frame, **options):
    label = hard_negatives.shifted_label(F.col("label"))
    got = hard_negatives.mine(frame.withColumn("label", label), **options)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.select(*names).collect()))


@pytest.mark.parametrize("kind", ["plain", "odd", "ties"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(2)
    vectors = np.float32(rng.normal(size=(700, 24)) / 5)
    labels = rng.integers(0, 10, 700)
    if kind == "ties":
        vectors = np.float32(rng.integers(0, 2, size=(700, 24)))
        vectors[:250] = vectors[0]
    rows = [(int(i), int(x), v.tolist()) for i, (x, v) in enumerate(zip(labels, vectors))]
    if kind == "odd":
        big = [300.0] * 24
        rows += [
            (None, 1, rows[0][2]), (750, None, rows[0][2]), (800, 1, None), (850, 1, [1.0, None]), (900, 1, [float("nan")] * 24),
            (950, 2, [float("inf")] * 24), (1000, 3, []), (1050, 3, [0.5] * 7), (-50, 4, [0.5] * 9), (1100, 5, big), (1101, 6, big),
            (1103, 5, big), (1150, 77, [0.1] * 24),
        ]
    # an anchor of a label with one row, and negative products
    got = mined(frame_of(spark, rows))
    assert got == brute_negatives(rows) and (len(got) > 50 or kind == "ties")


def test_hard_negatives_of_repeated_rows_and_nothing(spark):
    rows = [(50, 1, [1.0, 0.0])] * 2 + [(51, 1, [1.0, 0.5])] * 2 + [(52, 2, [0.75, 0.0]), (53, 3, [0.75, 0.0])]
    got = mined(frame_of(spark, rows))
    assert got == brute_negatives(rows) and got[0][:4] == (50, 50, 1, 52)
    assert mined(frame_of(spark, rows).limit(0)) == []
    assert mined(frame_of(spark, [r for r in rows if r[0] != 50])) == []
    with pytest.raises(ValueError, match="long"):
        mined(frame_of(spark, [(50, 1, [1e30, 1.0]), (51, 1, [1.0, 1.0])]))


def test_columns_are_read_until_candidates_are_out():
    """The bounds hold at every step, and most candidates leave before the last column."""
    rng = np.random.default_rng(1)
    matrix = rng.integers(-40, 41, size=(64, 500))
    anchor = rng.integers(-40, 41, size=64) * (rng.random(64) < 0.25)
    block = hard_negatives.Block.__new__(hard_negatives.Block)
    block.columns, block.ends = matrix.astype("i2"), (matrix.min(1), matrix.max(1))
    exact, seen = anchor @ matrix, []

    def useful(lower, upper):
        seen.append(len(lower))
        assert (lower <= exact[alive_of(len(lower))]).all() if len(lower) == 500 else True
        return upper >= hard_negatives.kth(lower, 5)

    def alive_of(n):
        return np.arange(n)

    alive, scores = hard_negatives.scan(block, anchor, np.arange(500), useful)
    assert (scores == exact[alive]).all() and set(np.argsort(-exact)[:5]) <= set(alive.tolist())
    assert seen[-1] < 100


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, floors(v, 64)) for i, v in rows if usable(v) and len(v) == 64]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), n) for n, p in enumerate(points))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            points[n] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, n, d in found:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in found), key=repr)


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_clusters_equal_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(centroids, "CHUNK", 90)
    rng = np.random.default_rng(6)
    vectors = np.float32(rng.normal(size=(300, 64)) / 8)
    vectors[:100] = vectors[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [rows[5], rows[5], (5, rows[9][1]), (None, rows[7][1]), (400, None), (401, [0.5] * 63), (402, [0.5] * 65), (403, []),
             (404, [None] + [0.5] * 63), (405, [float("nan")] * 64), (406, [float("-inf")] + [0.0] * 63), (407, [9000.0] * 64)]
    frame = spark.createDataFrame([(*r, "c", 0) for r in rows], "vec_id long, embedding array<float>, cluster string, v int")
    got = centroids.cluster(frame.repartition(4), width=width)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got.columns == names and sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [i / 10] * 64) for i in range(3)]
    got = centroids.cluster(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_clusters(rows) and {r.distance for r in got} == {0}
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema)).collect()


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_centroids"])
def test_sql(spark, sf, name):
    from catalog.check import compare, connect, types

    df, rel = queries.QUERIES[name](spark, sf), connect(sf).sql(queries.ORACLES[name])
    assert compare(df.toPandas(), rel.df()) == "" and types(df, rel) == ""
