"""Search, hard negatives and clustering of vectors against plain Python, and what they do at the edges."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm import kmeans, negatives, tiles, topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
NAN, INF = math.nan, math.inf


@pytest.fixture
def table(spark):
    return lambda rows, parts=3: spark.createDataFrame([(*r, None)[:3] for r in rows], SCHEMA).repartition(parts)


def taken(rows, factor):
    """(id, whole components, label) of the rows that take part."""
    return [(i, tuple(math.floor(factor * float(np.float32(x))) for x in v), *r) for i, v, *r in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_search(queries, rows, k, factor=256):
    out, mine = [], {}
    for i, v in sorted((i, [float(np.float32(x)) for x in v]) for i, v, *_ in queries if taken([(i, v)], factor)):
        mine.setdefault(i, tuple(math.floor(factor * x) for x in v))
    for q, v in mine.items():
        best = {}
        for c, w, *_ in taken(rows, factor):
            if c != q and len(w) == len(v):
                best[c] = max(best.get(c, -INF), dot(v, w))
        out += [(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def brute_negatives(rows, is_anchor, k=5, low=80, high=100, factor=256):
    own = [r for r in taken(rows, factor) if r[2] is not None]
    anchors = {}
    for i, v, label in sorted(own, key=lambda r: (r[0], r[2], r[1])):
        if is_anchor(i):
            anchors.setdefault(i, (v, label))
    out = []
    for a, (v, label) in anchors.items():
        same, other = {}, {}
        for c, w, theirs in own:
            if c != a and len(w) == len(v):
                side = same if theirs == label else other
                side.setdefault(c, []).append(dot(v, w))
        for p, ps in sorted(((c, max(s)) for c, s in same.items()), key=lambda x: (-x[1], x[0]))[:k]:
            inside = {c: max(x for x in s if low * ps <= 100 * x <= high * ps) for c, s in other.items() if any(low * ps <= 100 * x <= high * ps for x in s)}
            out += [(a, p, n + 1, c, ps, s) for n, (c, s) in enumerate(sorted(inside.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def brute_clusters(rows, k=16, rounds=3, dim=64, factor=64):
    own = [(i, tuple(math.floor(factor * float(np.float32(x))) for x in v)) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in first]
    for r in range(rounds + 1):
        at = [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in own]
        if r < rounds:
            for j in range(len(centers)):
                held = [v for (_, v), a in zip(own, at) if a[1] == j]
                if held:
                    centers[j] = tuple(sum(x) // len(held) for x in zip(*held))
    inertia = [sum(d for d, c in at if c == j) for j in range(len(centers))]
    return sorted(((i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(own, at)), key=str)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def searched(df):
    return sorted(rows_of(df, "query_id", "rank", "vec_id", "score"))


def mined(df):
    return sorted(rows_of(df, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def clustered(df):
    return rows_of(df, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def some_rows(n, dim, seed, steps=3, labels=3):
    """Few different components, so scores tie; a third of the rows are one vector."""
    r = random.Random(seed)
    return [(i, [0.5] * dim if r.random() < 0.33 else [r.randint(-steps, steps) / 8 for _ in range(dim)], r.randrange(labels)) for i in range(n)]


ODD = [
    (None, [1.0, 0.0], 1), (100, None, 1), (101, [None, 1.0], 1), (102, [NAN, 1.0], 1), (103, [INF, 1.0], 2), (104, [-INF, 0.5], 2), (105, [1.0, 0.5], None),
    (200, [0.5, 0.5], 1), (200, [0.5, 0.5], 1), (200, [0.25, 1.0], 2), (201, [0.5, 0.5], 1), (201, [0.75, 0.5], 1), (202, [1.0, 0.4], 2), (203, [1.0, 0.4], 2), (204, [1.0], 1),
    (205, [0.5, 0.5, 0.5], 1), (300, [0.5, 0.5, 0.5], 1), (206, [], 1), (400, [], 1), (207, [0.4, 0.5], 2), (208, [-0.5, -0.5], 1), (500, [-0.5, -0.5], 1), (209, [-0.6, -0.4], 2),
]


@pytest.mark.parametrize("rows", [some_rows(300, 4, 1), some_rows(90, 3, 2, steps=1), ODD, [], [(0, [1.0], 0)], [(50, [1.0], 0), (50, [1.0], 0)]])
def test_search_against_brute_force(table, rows):
    df = table(rows)
    assert searched(topk.search(df.where("vec_id % 50 = 0"), df)) == brute_search([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows, 5)


def test_search_of_very_large_components_is_exact(table):
    rows = [(i, [x, 1.0, -x / 3], 0) for i, x in enumerate([2.0**12, 2.0**20 + 1, 2.0**20, 2.0**21, 1.5, 0.0])]
    df = table(rows)
    assert searched(topk.search(df, df, k=3)) == brute_search(rows, rows, 3)
    found = searched(topk.search(table([(0, [1e30], 0)]), table([(1, [1e30], 0), (2, [-1e30], 0)])))
    assert found == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]


def test_blocks_bunches_and_stripes(spark, table, monkeypatch):
    """Many small blocks on both sides give what one block gives."""
    rows = some_rows(700, 5, 4)
    df = table(rows, 4)
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    monkeypatch.setattr(tiles.pack, "__defaults__", (13, None, (), None))
    assert searched(topk.search(df.where("vec_id % 20 = 0"), df)) == brute_search([r for r in rows if r[0] % 20 == 0], rows, 5)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 6)
    assert mined(negatives.mine(df, df.where("vec_id % 20 = 0"))) == brute_negatives(rows, lambda i: i % 20 == 0)


@pytest.mark.parametrize("rows", [some_rows(400, 4, 5), some_rows(200, 6, 6, steps=8, labels=2), ODD, [], [(0, [1.0], 0)], [(0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1)]])
def test_hard_negatives_against_brute_force(table, rows):
    df = table(rows)
    assert mined(negatives.mine(df, df.where("vec_id % 100 = 0"))) == brute_negatives(rows, lambda i: i % 100 == 0)


def test_other_bands_and_counts(table):
    rows = some_rows(300, 5, 7, steps=9)
    df = table(rows)
    got = mined(negatives.mine(df, df.where("vec_id % 30 = 0"), positives=5, negatives=5, low=33, high=95))
    assert got == brute_negatives(rows, lambda i: i % 30 == 0, low=33, high=95) and got


def test_brackets_hold_and_discard():
    """No score lies outside its bracket, and rows far from an anchor's cluster are discarded unmultiplied."""
    r = np.random.default_rng(3)
    centers = r.integers(-200, 200, (6, 16))
    values = np.concatenate([c + r.integers(-6, 7, (60, 16)) for c in centers]).astype(np.float64)
    anchors = values[::20]
    height = float(np.square(values).sum(1).max())
    pivots = {16: values[:: len(values) // 8][:8]}
    stored = [np.frombuffer(negatives._table(pivots, h, x, {})["pivots"], np.float32).reshape(len(x), -1) for h, x in ((None, anchors), (height, values))]
    bracket, exact = negatives.Bracket(anchors, *stored, height), anchors @ values.T
    assert (bracket.low <= exact).all() and (exact <= bracket.high).all()
    best = np.sort(exact, 1)[:, -5, None]
    assert (bracket.high < best).mean() > 0.5


@pytest.mark.parametrize("rows", [some_rows(300, 64, 8), some_rows(60, 64, 9, steps=1), some_rows(7, 64, 10), [], [(None, [0.5] * 64), (None, None), (1, [0.5] * 63), (2, [NAN] * 64), (3, [0.25] * 64), (3, [0.25] * 64), (4, [None] * 64), (5, [INF] * 64)]])
def test_clusters_against_brute_force(table, rows):
    assert clustered(kmeans.clusters(table(rows))) == brute_clusters(rows)


def test_clusters_of_very_large_components(table):
    rows = [(i, [float(x)] * 64) for i, x in enumerate([1e6, 2e6, -3e6, 5.0, 1e6, 7e5])]
    assert clustered(kmeans.clusters(table(rows), k=2)) == brute_clusters(rows, k=2)


def test_bounds_spare_distances_and_hold(table):
    """On separated groups later rounds measure few distances; bounds stay on their sides of the exact distances."""
    r = np.random.default_rng(5)
    values = np.concatenate([c + r.integers(-5, 6, (100, 8)) for c in r.integers(-300, 300, (6, 8))]).astype(np.int16)
    centers = [values[i].tolist() for i in range(0, 600, 75)]
    cluster = upper = lower = before = None
    shares = []
    for _ in range(5):
        own = kmeans.Centroids(centers, before)
        cluster, upper, lower, measured = kmeans.assign(values, own, cluster, upper, lower)
        exact = ((values[:, None].astype(np.int64) - np.array(centers)[None]) ** 2).sum(2)
        assert (cluster == exact.argmin(1)).all()
        assert (upper.astype(np.float64) ** 2 >= exact[np.arange(600), cluster]).all() and (lower.astype(np.float64) ** 2 <= exact).all()
        shares.append(measured / exact.size)
        before, centers = centers, [(values[cluster == j].sum(0, dtype=np.int64) // max(1, (cluster == j).sum())).tolist() if (cluster == j).any() else centers[j] for j in range(len(centers))]
    assert shares[0] > 0.3 and shares[-1] < 0.05


def test_clashing_columns_and_wide_types(spark, table):
    rows = some_rows(120, 64, 11)
    df = table(rows)
    extra = df.select("*", F.lit(1).alias("score"), F.lit("x").alias("Embedding"), F.lit(2).alias("block"), F.lit(3).alias("data"), F.lit(None).alias("bucket"), F.lit(1).alias("rank"))
    doubles = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert searched(topk.search(extra, extra)) == searched(topk.search(df, doubles))
    assert mined(negatives.mine(extra, extra.where("vec_id % 10 = 0"))) == mined(negatives.mine(df, df.where("vec_id % 10 = 0")))
    assert clustered(kmeans.clusters(extra)) == clustered(kmeans.clusters(doubles))


def test_empty_tables_keep_their_schema(spark, table):
    df = table([])
    assert topk.search(df, df).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert negatives.mine(df, df).count() == 0 and kmeans.clusters(df).dtypes[1] == ("cluster", "int")
