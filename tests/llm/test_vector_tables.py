"""Layouts of the Hamming tables: the miss stays, the work per vector grows slowly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framesift.llm import itq, rabitq


def near_pairs(dims=64, n=3000, cosine=0.9):
    """Pairs of vectors at exactly this cosine."""
    rng = np.random.default_rng(17)
    a = rng.standard_normal((n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dims))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_layouts_keep_the_miss_at_every_size():
    a, b = near_pairs()
    projection = itq.fit_rotation(a, words=itq.MOST_WORDS)
    ca, cb = itq.codes_of(a, projection), itq.codes_of(b, projection)
    chosen, share = [], []
    for n_rows in (10**3, 10**5, 10**7, 10**9):
        sizes = itq.chunk_sizes(0.9, n_rows, a, ca)
        words = sum(sizes) // itq.BITS
        most = itq.allowed_distance(0.9, words)
        near = np.bitwise_count(ca[:, :words] ^ cb[:, :words]).sum(axis=1) <= most
        assert ((itq.canonical_keys(ca, cb, sizes) >= 0) & near).mean() >= 0.95, sizes
        other = np.roll(np.arange(len(a)), 1)
        far = itq.canonical_keys(ca, ca[other], sizes) >= 0
        chosen.append(itq.n_keys(sizes))
        share.append(far.mean())
    assert chosen == sorted(chosen) and chosen[-1] < 40 * chosen[0]  # a millionfold of the rows
    assert share[-1] < 1e-2 < share[0] + 1e-2 and share[-1] <= share[0]


def test_links_with_long_codes(spark, monkeypatch):
    """The layout meant for a thousand million vectors, on a few."""
    a, b = near_pairs(n=150, cosine=0.93)
    x = np.concatenate([a, b])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = itq.chunk_sizes
    monkeypatch.setattr(itq, "chunk_sizes", lambda cosine, n_rows, *rest: whole(cosine, 10**9, *rest))
    got = {r.vec_id: r for r in itq.near_vectors(table).collect()}
    assert sum(got[i].component_id == i % 150 for i in range(300)) >= 295
    assert all(r.n_links <= 1 for r in got.values())
    assert itq.near_vectors(table.filter(F.col("vec_id") < 1)).collect()[0].kept


def test_repeated_query_ids_ask_with_the_least_vector(spark):
    rows = [(100, [5.0, 0.0]), (100, [1.0, 9.0]), (1, [1.0, 9.5]), (2, [5.0, 0.25]), (3, [-4.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts in (1, 3, 5):
        got = rabitq.nearest_vectors(table.repartition(parts), lambda i: i % 100 == 0, k=2).orderBy("rank").collect()
        assert [(r.query_id, r.vec_id) for r in got] == [(100, 1), (100, 3)] and got[0].score == 0.5
