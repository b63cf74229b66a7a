"""Sparse k-means against dense loops over the same points."""

import math
import random

import pytest

from lumicat.operators import cluster, topic_clusters
from lumicat.plans import documents, registry

ROWS, WEIGHTS = "id string, token string, value double", "id string, weight double"


def dot(a, b):
    return round(sum(v * b.get(t, 0.0) for t, v in a.items()), 9)


def brute(rows, weights, k, rounds):
    """Labels and whether they settled; every similarity is computed in every round."""
    points = {}
    for i, t, v in rows:
        points.setdefault(i, {})[t] = v
    points = {i: {t: v / math.sqrt(sum(x * x for x in p.values())) for t, v in p.items()} for i, p in points.items()}
    centres = [points[min(points, key=lambda i: (-weights[i], i))]]
    best = dict.fromkeys(points, 0.0)
    for _ in range(k - 1):
        best = {i: max(b, dot(points[i], centres[-1])) for i, b in best.items()}
        far = min(points, key=lambda i: (-round((1 - best[i]) * weights[i], 9), i))
        centres.append(points[far])
    nearest = lambda p: min(range(k), key=lambda c: (-dot(p, centres[c]), c))
    labels = {i: nearest(p) for i, p in points.items()}
    for _ in range(rounds):
        for c in range(k):
            total = {}
            for i, p in points.items():
                for t, v in p.items() if labels[i] == c else ():
                    total[t] = total.get(t, 0.0) + v * weights[i]
            assert total
            norm = math.sqrt(sum(x * x for x in total.values()))
            centres[c] = {t: x / norm for t, x in total.items()}
        after = {i: nearest(p) for i, p in points.items()}
        if after == labels:
            return labels, True
        labels = after
    return labels, False


def found(spark, rows, weights, k, rounds=80, **options):
    made = topic_clusters.sparse_kmeans(spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(weights.items()), WEIGHTS), k, rounds, **options).collect()
    return {r.id: r.cluster for r in made}, {r.settled for r in made}, {r.id: r.similarity for r in made}


@pytest.mark.parametrize("seed, k, rounds, most", [(1, 3, 80, None), (2, 5, 80, 0), (3, 4, 1, None), (4, 2, 80, None)])
def test_brute(spark, seed, k, rounds, most):
    rng = random.Random(seed)
    rows = [(f"p{i}", f"t{t}", rng.uniform(0.1, 2.0)) for i in range(120) for t in {rng.randrange(6) + 5 * (i % k) for _ in range(rng.randint(1, 5))}]
    weights = {f"p{i}": float(rng.randint(1, 9)) for i in range(120)}
    labels, settled = brute(rows, weights, k, rounds)
    got, flags, similar = found(spark, rows, weights, k, rounds, most=most)
    assert got == labels and flags == {settled} and all(-1e-9 <= s <= 1 + 1e-9 for s in similar.values())


def test_topics_of_the_catalogue(spark, sf_dir):
    topics = documents._topics(spark, sf_dir)
    rows = [tuple(r) for r in cluster.tfidf(topics, documents.STOP).collect()]
    weights = {r.topic: r.weight for r in topics.collect()}
    labels, settled = brute(rows, weights, 8, 80)
    got = registry.queries()["clu_kmeans_topics"](spark, sf_dir).collect()
    assert {r.topic: r.cluster for r in got} == labels and {r.settled for r in got} == {settled}


def test_few_compared_again(spark):
    """Of clusters that stand apart, settled points are not compared again."""
    rows = [(f"p{i}", f"t{i % 3}", 1.0) for i in range(30)] + [(f"p{i}", f"own{i}", 0.05) for i in range(30)]
    weights = {f"p{i}": 1.0 for i in range(30)}
    seen = []
    whole = topic_clusters._similar
    topic_clusters._similar = lambda r, t, p, k: (seen.append(p.count()), whole(r, t, p, k))[1]
    try:
        labels, flags, _ = found(spark, rows, weights, 3)
    finally:
        topic_clusters._similar = whole
    assert flags == {True} and len(set(labels.values())) == 3 and seen[0] == 30 and seen[-1] == 0


def test_odd_points(spark):
    rows = [("a", "x", 1.0), ("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 3.0), ("zero", "x", 0.0), ("null", "y", None), (None, "y", 1.0), ("gone", "x", 1.0), ("gone", "x", -1.0)]
    labels, flags, similar = found(spark, rows, {"a": 1.0, "b": 2.0}, 2)
    assert set(labels) == {"a", "b", "c"} and all(s == pytest.approx(1) for s in similar.values())  # equal points, an empty cluster
    assert found(spark, rows, {"a": 1.0}, 5)[0] == {"a": 0, "b": 1, "c": 2}
    assert found(spark, rows, {"a": 1.0}, 1)[1] == {True}
    empty = topic_clusters.sparse_kmeans(spark.createDataFrame([], ROWS), spark.createDataFrame([], WEIGHTS))
    assert empty.count() == 0
