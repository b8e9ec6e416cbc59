"""Similar pairs against a plain loop, on every path of the operator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import matching, rounds, similarity
from framesift.operators.matching import connected_components, greedy_similar_pairs, number_pairs
from framesift.operators.near_copies import twin_groups
from framesift.operators.similarity import choose_pivots, cosine_pairs, distinct_pairs, equal_groups


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n > 0 else None


def walk(rows, t):
    free, out = [], []
    for j, v in sorted(rows, key=lambda r: r[0]):
        for at, (i, w) in enumerate(free):
            c = cosine(v, w)
            if c is not None and c > t:
                out.append((j, i))
                del free[at]
                break
        else:
            free.append((j, v))
    return sorted(out)


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"id {kind}, v array<float>")


def single(rows):
    return [(i, np.float32(v).astype(float)) for i, v in rows]


def mixed(seed, n=160):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 4)).round(1)
    return single(
        (i, base[0] if rng.random() < 0.35 else base[rng.integers(6)] if rng.random() < 0.5 else rng.normal(size=4))
        for i in range(n)
    )


def burst(n=40):
    """Each picture is like the next one only."""
    step = 0.5
    return single((i, np.array([np.cos(step * i), np.sin(step * i), 0.02 * i])) for i in range(n))


def hot(n=240):
    """A third and more are copies, in long runs and mixed with pictures like them."""
    rng = np.random.default_rng(9)
    c = rng.normal(size=5)
    rows = [c] * (n // 2) + [rng.normal(size=5) for _ in range(n // 8)] + [c + rng.normal(size=5) * 0.3 for _ in range(9)]
    rows += [c] * (n // 4) + [np.zeros(5)] * 2 + [c + rng.normal(size=5) * 0.3 for _ in range(5)] + [c] * 21
    return single(enumerate(rows))


CASES = {
    "mixed": (mixed(1), 0.8), "mixed2": (mixed(2), 0.9), "burst": (burst(), 0.85),
    "hot": (hot(), 0.85), "clique": (single((i, np.ones(3) + 0.01 * i) for i in range(31)), 0.5),
    "none": (single((i, np.eye(8)[i]) for i in range(8)), 0.5),
}


def near(n=120, seed=3):
    """Half of the set are near copies; others lie around the threshold angle from them."""
    rng = np.random.default_rng(seed)
    c = np.array([1.0, 0, 0, 0, 0, 0])
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            v = c + rng.normal(size=6) * 0.004
        elif kind < 0.6:
            v = c
        elif kind < 0.8:  # near the border of being similar to the copies
            side = np.r_[0, rng.normal(size=5)]
            at = np.arccos(0.85) + rng.normal() * 0.004
            v = np.cos(at) * c + np.sin(at) * side / np.linalg.norm(side)
        else:
            v = rng.normal(size=6)
        rows.append((i, v))
    return single(rows)


CASES["near"] = (near(), 0.85)


@pytest.mark.parametrize(
    "case,sizes", [("near", {}), ("near", {"block_rows": 16}), ("hot", {})]
)
def test_merging_near_copies_changes_nothing(spark, case, sizes):
    rows, t = CASES[case]
    got = greedy_similar_pairs(frame(spark, rows), "id", "v", t, **sizes).collect()
    assert sorted((r.moved, r.kept) for r in got) == walk(rows, t)
    at = dict(rows)
    assert all(r.similarity == pytest.approx(cosine(at[r.moved], at[r.kept])) for r in got)


def test_near_copies_need_few_edges(spark):
    rng = np.random.default_rng(1)
    rows = single((i, np.eye(6)[0] + rng.normal(size=6) * 0.002) for i in range(300))
    groups, links = twin_groups(frame(spark, rows).select("id", F.col("v").alias("vec")), 0.85)
    assert groups.select("clump").distinct().count() < 40 and links.count() < 800


@pytest.mark.parametrize(
    "case,task_rows", [(c, 100_000) for c in sorted(CASES)] + [("hot", 90), ("burst", 30), ("mixed", 150)]
)
def test_greedy_is_the_walk(spark, case, task_rows):
    rows, t = CASES[case]
    got = greedy_similar_pairs(frame(spark, rows), "id", "v", t, task_rows=task_rows)
    assert sorted((r.moved, r.kept) for r in got.collect()) == walk(rows, t)


def test_partitions_and_order_do_not_matter(spark):
    rows, t = CASES["mixed"]
    df = frame(spark, rows[::-1]).repartition(5)
    got = greedy_similar_pairs(df, "id", "v", t, task_rows=60, block_rows=16, cell_rows=30)
    assert sorted((r.moved, r.kept) for r in got.collect()) == walk(rows, t)


def test_text_ids(spark):
    rows = [(f"img{i:03d}", v) for i, v in mixed(4, 60)]
    got = greedy_similar_pairs(frame(spark, rows, "string"), "id", "v", 0.8, task_rows=25)
    assert sorted((r.moved, r.kept) for r in got.collect()) == walk(rows, 0.8)


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0])], "id long, v array<float>")
    assert greedy_similar_pairs(df, "id", "v", 0.5).count() == 0


def test_cells_are_divided_until_small(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_PIVOTS", 2)
    monkeypatch.setattr(similarity, "FANOUT", 4)
    rng = np.random.default_rng(11)
    vecs = rng.standard_normal((900, 3)) * rng.uniform(0.1, 9, (900, 1))
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T > 0.998, 1)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    seen = []
    whole = similarity.small_cells
    monkeypatch.setattr(similarity, "small_cells", lambda *a: seen.append(whole(*a)) or seen[-1])
    got = [(r["earlier"], r["later"]) for r in distinct_pairs(df, 0.998, len(vecs), cell_rows=60, block_rows=25).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    cells = seen[0].groupBy("cell").agg(F.max("_size").alias("n"), F.max("whole").alias("whole")).collect()
    assert max(c["n"] for c in cells) <= 60
    assert max(c["whole"] for c in cells) >= 7  # three levels or more


def test_cell_that_cannot_be_divided_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_PIVOTS", 2)
    vecs = 1 + 0.01 * np.random.default_rng(5).standard_normal((120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = [(r["earlier"], r["later"]) for r in distinct_pairs(df, 0.9, 120, cell_rows=20, block_rows=16).collect()]
    assert len(got) == len(set(got)) == 120 * 119 // 2


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20}, {"cell_rows": 25}, {"cell_rows": 40, "block_rows": 11}])
def test_join_is_exact(spark, sizes):
    rows = mixed(3)
    t = 0.7
    want = sum(
        1 for a in range(len(rows)) for b in range(a) if (c := cosine(rows[a][1], rows[b][1])) is not None and c > t
    )
    got = cosine_pairs(frame(spark, rows), "id", "v", t, **sizes).collect()
    assert sum(r.n_pairs for r in got) == want
    assert all(r.earlier <= r.later for r in got)
    assert len({(r.earlier, r.later) for r in got}) == len(got)


def test_cells_prune_far_clusters(spark):
    """With well separated clusters a vector visits few cells."""
    rng = np.random.default_rng(0)
    rows = single((i, np.eye(12)[i % 12] * 10 + rng.normal(size=12) * 0.1) for i in range(240))
    df = frame(spark, rows).select("id", F.col("v").alias("vec"))
    pivots = choose_pivots(df, 240, 20)
    assert len(pivots) == 12
    assert distinct_pairs(df, 0.9, 240, cell_rows=20).count() == 12 * 20 * 19 // 2


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        greedy_similar_pairs(frame(spark, CASES["none"][0]), "id", "v", 1.5)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 200), (200, 300), (100, 300)]
    df = spark.createDataFrame(links, "earlier long, later long")
    got = {r.node: r.comp for r in connected_components(df).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {20}
    assert got[300] == 100 and len(got) == 63


def test_numbering(spark):
    pairs = spark.createDataFrame([(i * 7 % 101, i, 0.9) for i in range(101)], "moved long, kept long, similarity double")
    assert [r.moved for r in number_pairs(pairs).orderBy("pair_no").collect()] == list(range(101))


def crowd(n, seed=4, width=3):
    """One large component: every picture is like some fifteen others."""
    rng = np.random.default_rng(seed)
    return single((i, rng.normal(size=width)) for i in range(n))


def test_rounds_pair_a_giant_component_like_the_walk(spark, monkeypatch):
    rows = crowd(900)
    seen = []

    def counted(*args, **options):
        seen.append(rounds.match_rounds(*args, **options))
        return seen[-1]

    monkeypatch.setattr(matching, "match_rounds", counted)
    got = greedy_similar_pairs(frame(spark, rows), "id", "v", 0.97, task_rows=2000)
    assert sorted((r.moved, r.kept) for r in got.collect()) == walk(rows, 0.97)
    assert seen and all(not x.stalled and x.n_rounds < 30 for x in seen)


@pytest.mark.parametrize("t,enough", [(0.2, 0), (0.9, 0), (0.9, 40)])
def test_rounds_alone(spark, t, enough):
    """Rounds to the end, or to what is enough, on copies, runs, twins and whole links."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(7, 3))
    rows = single((i, base[rng.integers(7)] if rng.random() < 0.6 else base[rng.integers(7)] + rng.normal(size=3) * 0.05) for i in range(150))
    _, groups, distinct, _ = equal_groups(frame(spark, rows), "id", "v")
    groups, links = matching._merged_groups(groups, distinct, t, {})
    done = rounds.match_rounds(groups, links, enough, max_rounds=200, least_share=0.0)
    pairs = sorted((r.moved, r.kept) for r in done.pairs.collect())
    if not enough:
        assert pairs == walk(rows, t)
    else:
        assert set(pairs) < set(walk(rows, t)) and done.images.count() + done.links.count() <= enough


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 23, "block_rows": 16}])
def test_chunks_of_arrivals_are_the_walk(spark, case, sizes):
    rows, t = CASES[case]
    got = greedy_similar_pairs(frame(spark, rows), "id", "v", t, dense_links=0.0, **sizes).collect()
    assert sorted((r.moved, r.kept) for r in got) == walk(rows, t)
    at = dict(rows)
    assert all(r.similarity == pytest.approx(cosine(at[r.moved], at[r.kept])) for r in got)


def test_chunks_take_text_ids_and_skip_rows_without(spark):
    rows = [(f"img{i:03d}", v) for i, v in mixed(4, 60)]
    df = frame(spark, [*rows, (None, rows[3][1])], "string")
    got = greedy_similar_pairs(df, "id", "v", 0.8, dense_links=0.0, chunk_rows=25)
    assert sorted((r.moved, r.kept) for r in got.collect()) == walk(rows, 0.8)


def test_many_partners_list_no_links(spark, monkeypatch):
    """1,500 images with some 60 partners each: no link is listed, and no round is made."""
    rows = crowd(1500, width=6)
    t = 0.75
    monkeypatch.setattr(matching, "twin_groups", None)
    got = greedy_similar_pairs(frame(spark, rows), "id", "v", t, chunk_rows=400)
    assert sorted((r.moved, r.kept) for r in got.collect()) == walk(rows, t)


def test_many_within_reach_of_clumps_list_no_links(spark, monkeypatch):
    """700 images with some two partners each, but a third of all within the reach of the clumps: no link is listed."""
    rows = crowd(700, width=64)
    monkeypatch.setattr(matching, "twin_groups", None)
    got = greedy_similar_pairs(frame(spark, rows), "id", "v", 0.35, chunk_rows=300)
    assert sorted((r.moved, r.kept) for r in got.collect()) == walk(rows, 0.35)
