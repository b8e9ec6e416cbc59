from __future__ import annotations

import numpy as np
import pytest

from framesift.operators import clusters as cl


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def blobs(seed=0, n=90):
    rng = np.random.default_rng(seed)
    return np.eye(3)[np.arange(n) % 3] * 8 + rng.normal(size=(n, 3))


def by_hand(points, labels, centers, method):
    out = {}
    for c in range(len(centers)):
        best = None
        for i in np.flatnonzero(labels == c):
            if method == "consistency":
                score = -np.linalg.norm(points[i] - centers[c])
            else:
                score = min((np.linalg.norm(points[i] - o) for k, o in enumerate(centers) if k != c), default=0)
            if best is None or score > best[0]:
                best = (score, i)
        if best:
            out[c] = int(best[1])
    return out


@pytest.mark.parametrize("k", [1, 3, 7])
@pytest.mark.parametrize("method", cl.METHODS)
def test_selection(spark, k, method):
    points = blobs()
    points[5] = points[8]  # tie: the first one wins
    assigned, centers = cl.kmeans(frame(spark, points), "id", "v", k)
    labels = np.array([r.cluster for r in assigned.orderBy("id").collect()])
    got = {r.cluster: r.id for r in cl.select_images(assigned, "id", "v", centers, method).collect()}
    assert got == by_hand(points, labels, centers, method)


def test_more_clusters_than_images(spark):
    assigned, centers = cl.kmeans(frame(spark, blobs(n=4)), "id", "v", 10)
    assert len(centers) == 4 and assigned.select("cluster").distinct().count() == 4


def test_no_embeddings(spark):
    with pytest.raises(ValueError):
        cl.kmeans(frame(spark, blobs(n=4)).limit(0), "id", "v", 2)


def test_lloyd_does_not_depend_on_partitions(spark):
    df = frame(spark, blobs(3))
    one = {r.id: r.cluster for r in cl.kmeans(df, "id", "v", 3)[0].collect()}
    two = {r.id: r.cluster for r in cl.kmeans(df.repartition(7).sort("v"), "id", "v", 3)[0].collect()}
    assert one == two and len(set(one.values())) == 3


def test_engines_agree_on_clear_clusters(spark):
    df = frame(spark, blobs(5))
    cost = []
    for engine in ("lloyd", "ml"):
        assigned, _ = cl.kmeans(df, "id", "v", 3, engine=engine)
        cost.append(sum(r.distance**2 for r in assigned.collect()))
    assert cost[0] == pytest.approx(cost[1], rel=1e-6)


def test_centers_are_bounded():
    with pytest.raises(ValueError):
        cl._check_centers(np.zeros((1 << 13, 1 << 13)))


def test_plot(spark):
    points = blobs() * [1, 2, 3]  # no two axes of equal weight
    df = frame(spark, points)
    assigned, centers = cl.kmeans(df, "id", "v", 3)
    picked = cl.select_consistency(assigned, "id", "v", centers)
    flat = points - points.mean(axis=0)
    axes = np.linalg.svd(flat)[2][:2].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    for rows in (assigned, assigned.repartition(7)):
        got = cl.plot_data(rows, picked, "id", "v").orderBy("id").collect()
        assert len(got) == 90 and sum(r.is_selected for r in got) == 3
        assert np.allclose([(r.x, r.y) for r in got], flat @ axes, atol=1e-9)


def test_distances_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    x, centers = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    whole = np.linalg.norm(x[:, None] - centers[None], axis=2)
    monkeypatch.setattr(cl, "SPACE_BYTES", 1000)  # four rows at a time
    assert np.allclose(cl._distances(x, centers), whole)


def test_size_is_checked_before_centers_are_made(spark, monkeypatch):
    monkeypatch.setattr(cl, "CENTER_BYTES", 8 * 3 * 2)
    monkeypatch.setattr(cl, "centers_matrix", None)
    with pytest.raises(ValueError, match="exceed"):
        cl.kmeans(frame(spark, blobs()), "id", "v", 3, init="first")


def test_first_centers_come_from_all_rows(spark):
    """Two far points among thousands of equal ones are found; equal vectors leave clusters empty."""
    points = np.zeros((3000, 2))
    points[1717], points[2999] = (50, 0), (0, 70)
    df = frame(spark, points)
    found = cl.spread_centers(df, "id", "v", 3)
    assert {tuple(c) for c in found} == {(0, 0), (50, 0), (0, 70)}
    assert (found == cl.spread_centers(df.repartition(5), "id", "v", 3)).all()
    more = cl.spread_centers(df, "id", "v", 5)
    assert len(more) == 5 and {tuple(c) for c in more} == {(0, 0), (50, 0), (0, 70)}
