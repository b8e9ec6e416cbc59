"""Greedy removal of similar pairs, with the exact result of visiting images in id order.

Rule: image j, on its turn, looks at the earlier images that are still free, in order, and
is paired with the first similar one. Both leave the game; j is moved, the other is kept.

Facts the distributed form rests on:

* Free images are never similar to each other. In a clump, a set of images that are all
  similar to each other, at most one is free at any time, so the state is one optional
  image per clump and pairs inside a clump need not be listed. Equal vectors are a clump.
* Links join twins, images of a clump with the same partners, and not single images.
* Connected components of clumps do not influence each other.
* In a component, take a run of arrivals of twins with no other arrival in between. Its
  first ``degree + 1`` arrivals use up every free neighbour; from then on the run pairs
  with itself. The middle of a long run can be cut out and filled in afterwards.

Tables here: ``groups`` (id, rep, clump, copies), with the twins' first id, the clump and
the number of images in it; ``links`` (clump, rep, other_clump, other, whole, similarity)
in both directions, between twins or, if ``whole``, between all images of two clumps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.vectors import cosine
from framesift.operators.arrivals import CHUNK_ROWS, DENSE_LINKS, LISTED_LINKS, match_arrivals, mean_links
from framesift.operators.near_copies import reach_of, twin_groups
from framesift.operators.rounds import match_rounds
from framesift.operators.similarity import BLOCK_ROWS, check_threshold, equal_groups
from framesift.operators.skew import join_to_unique, ordered_rank, ordered_slices
from framesift.session import save_table

TASK_ROWS = 200_000  # arrivals plus edges that one task may sweep


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for an edge table (earlier, later); comp is the lowest node reached.

    Each round takes the lowest label among neighbours and then the label of the label, so
    long chains shrink by a factor per round. Labels are stored each round.
    """
    both = save_table(
        edges.select(F.col("earlier").alias("node"), F.col("later").alias("other")).unionByName(
            edges.select(F.col("later").alias("node"), F.col("earlier").alias("other"))
        ),
        "links",
    )
    n_links = both.count()
    labels = save_table(
        both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("comp")),
        "labels",
    )
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("comp").alias("seen"))
        seen = (
            join_to_unique(both, of_other, ["other"], n_rows=n_links)
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        lowered = save_table(
            labels.join(seen, "node").select("node", "comp", F.least("comp", "seen").alias("next")), "labels"
        )
        jump = lowered.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = save_table(
            join_to_unique(lowered, jump, ["next"], n_rows=n_links).select(
                "node", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("changed")
            ),
            "labels",
        )
        labels = moved.select("node", "comp")
        if not moved.filter("changed").head(1):
            return labels


def _sweep(arrivals: Iterator[tuple], links: tuple[dict, dict], free: dict) -> Iterator[tuple]:
    """Visit (id, rep, clump) in order; yields (moved, kept, similarity).

    ``free`` maps a clump to its free (id, rep) and is updated.
    """
    of_twins, of_clump = links
    for image, rep, clump in arrivals:
        own = free.get(clump)
        best = (own[0], clump, 1.0) if own else None
        for other_clump, other, sim in of_twins.get(rep, ()):
            seen = free.get(other_clump)
            if seen and seen[1] == other and (best is None or seen[0] < best[0]):
                best = seen[0], other_clump, sim
        for other_clump, sim in of_clump.get(clump, ()):
            seen = free.get(other_clump)
            if seen and (best is None or seen[0] < best[0]):
                best = seen[0], other_clump, sim
        if best is None:
            free[clump] = image, rep
        else:
            del free[best[1]]
            yield image, best[0], best[2]


def _link_tables(links: pd.DataFrame) -> tuple[dict, dict]:
    of_twins: dict = {}
    of_clump: dict = {}
    for clump, rep, other_clump, other, whole, sim in zip(
        *(links[c] for c in ("clump", "rep", "other_clump", "other", "whole", "similarity"))
    ):
        if whole:
            of_clump.setdefault(clump, []).append((other_clump, sim))
        else:
            of_twins.setdefault(rep, []).append((other_clump, other, sim))
    return of_twins, of_clump


SWEPT = ["moved", "kept", "rep", "clump", "similarity"]


def _sweep_group(arrivals: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Sweep of one component: rows marked 'was' carry images still free from earlier blocks.

    Gives one row per pair (kept not null) and one per image newly left free (kept null).
    """
    arrivals = arrivals.sort_values("id", kind="stable")
    old = arrivals["was"].to_numpy(dtype=bool)
    before, now = arrivals[old], arrivals[~old]
    free = {c: (i, r) for i, r, c in zip(before["id"], before["rep"], before["clump"])}
    pairs = _sweep(zip(now["id"], now["rep"], now["clump"]), _link_tables(links), free)
    found = [(moved, kept, None, None, sim) for moved, kept, sim in pairs]
    carried = set(before["id"])
    left = [(i, None, r, c, None) for c, (i, r) in free.items() if i not in carried]
    return pd.DataFrame(found + left, columns=SWEPT)


def _runs(chunk: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
    """(start, kept prefix, length) of every run long enough to cut, in a chunk sorted by id."""
    reps = chunk["rep"].to_numpy()
    starts = [0] + [i for i in range(1, len(reps)) if reps[i] != reps[i - 1]] + [len(reps)]
    degree = chunk["degree"].to_numpy()
    for a, b in zip(starts, starts[1:]):
        prefix = int(degree[a]) + 1
        prefix += (b - a - prefix) % 2
        if b - a > prefix + 2:
            yield a, prefix, b - a


def _cut_runs(chunk: pd.DataFrame) -> pd.DataFrame:
    chunk = chunk.sort_values("id", kind="stable")
    keep = np.ones(len(chunk), dtype=bool)
    for start, prefix, length in _runs(chunk):
        keep[start + prefix + 1 : start + length - 1] = False
    return chunk[keep][["comp", "id", "rep", "clump", "degree"]]


def _fill_runs(chunk: pd.DataFrame, outcome: pd.DataFrame) -> pd.DataFrame:
    """Pairs inside the cut part of each run, given how its two end markers were paired.

    If the markers met each other, the tail pairs (1,2), (3,4) ...; that pair is replaced.
    Otherwise the first marker met someone free before it and the tail pairs (2,3), (4,5) ...
    """
    chunk = chunk.sort_values("id", kind="stable")
    ids = chunk["id"].tolist()
    partner = dict(zip(outcome["moved"], outcome["kept"]))
    rows: list = []
    drop: set = set()
    for start, prefix, length in _runs(chunk):
        tail = ids[start + prefix : start + length]
        met = partner.get(tail[-1]) == tail[0]
        if met:
            drop.add(tail[-1])
        at = 0 if met else 1
        rows += [(tail[i + 1], tail[i], 1.0) for i in range(at, len(tail) - 1, 2)]
    columns = ["moved", "kept", "similarity"]
    rows += outcome.loc[~outcome["moved"].isin(drop), columns].itertuples(index=False, name=None)
    return pd.DataFrame(rows, columns=columns)


def _sweep_large(arrivals: DataFrame, links: DataFrame, kind: str, task_rows: int) -> DataFrame:
    """Components beyond one task: cut runs chunk by chunk, then sweep in bounded blocks.

    ``arrivals`` (comp, id, rep, clump, degree), ``links`` with comp.
    """
    n_slices = max(1, -(-arrivals.count() // task_rows))
    chunks = ordered_slices(arrivals, ["comp", "id"], n_slices)
    cut = chunks.groupBy("comp", "_slice").applyInPandas(
        _cut_runs, f"comp {kind}, id {kind}, rep {kind}, clump {kind}, degree long"
    )
    ranked = ordered_rank(save_table(cut, "cut"), ["id"], ["comp"], "load", 1 + F.col("degree"), n_slices)
    block = F.floor((F.col("load") - 1) / F.lit(task_rows)).alias("block")
    blocks = save_table(ranked.select("comp", "id", "rep", "clump", block), "blocks")
    state = blocks.limit(0).select("comp", "id", "rep", "clump")
    found = None

    def sweep_block(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=[*SWEPT, "comp"])
        return _sweep_group(a, e).assign(comp=a["comp"].iloc[0])

    # every pass sweeps one block of every large component side by side
    for number in range(blocks.agg(F.max("block")).first()[0] + 1):
        now = save_table(blocks.filter(F.col("block") == number).select("comp", "id", "rep", "clump"), "now")
        here = now.select("clump").distinct()
        near = (
            links.filter(~F.col("whole")).join(now.select("rep").distinct(), "rep", "left_semi")
            .unionByName(links.filter("whole").join(here, "clump", "left_semi"))
        )
        near = save_table(near, "near")
        reach = near.select(F.col("other_clump").alias("clump")).unionByName(here).distinct()
        before = state.join(reach, "clump", "left_semi").select("comp", "id", "rep", "clump")
        seen = before.select("clump").unionByName(here).distinct().withColumnRenamed("clump", "other_clump")
        near = near.join(seen, "other_clump", "left_semi")
        rows = now.withColumn("was", F.lit(False)).unionByName(before.withColumn("was", F.lit(True)))
        swept = save_table(
            rows.groupBy("comp").cogroup(near.groupBy("comp")).applyInPandas(
                sweep_block,
                f"moved {kind}, kept {kind}, rep {kind}, clump {kind}, similarity double, comp {kind}",
            ),
            "swept",
        )
        pairs = swept.filter("kept is not null").select("moved", "kept", "similarity")
        used = pairs.select(F.col("kept").alias("id"))
        fresh = swept.filter("kept is null").select("comp", F.col("moved").alias("id"), "rep", "clump")
        state = save_table(state.join(used, "id", "left_anti").unionByName(fresh), "state")
        found = pairs if found is None else found.unionByName(pairs)
    # a marker pair lies inside one chunk: hand every pair to the chunk of its moved image
    place = chunks.select(F.col("id").alias("moved"), "comp", "_slice")
    outcome = save_table(found.join(place, "moved"), "outcome")
    return (
        chunks.groupBy("comp", "_slice")
        .cogroup(outcome.groupBy("comp", "_slice"))
        .applyInPandas(_fill_runs, f"moved {kind}, kept {kind}, similarity double")
    )


def _match_large(active: DataFrame, links: DataFrame, kind: str, task_rows: int) -> DataFrame:
    """Components beyond one task: rounds, then what they leave, in components again.

    Only where rounds pair next to nothing, in long chains, the rest is swept block by block.
    """
    done = match_rounds(active, links.drop("comp"), task_rows)
    columns = ["moved", "kept", F.lit(None).cast("double").alias("similarity")]
    if done.pairs is None:
        return _sweep_large(active, links, kind, task_rows)
    copies = save_table(done.images.groupBy("clump").agg(F.count(F.lit(1)).alias("copies")), "copies")
    left = save_table(join_to_unique(done.images, copies, ["clump"], weight="copies"), "groups")
    rest = match_groups(left, done.links, task_rows, rounds=not done.stalled)
    return done.pairs.select(*columns).unionByName(rest)


def match_groups(groups: DataFrame, links: DataFrame, task_rows: int = TASK_ROWS, rounds: bool = True) -> DataFrame:
    """(moved, kept, similarity) from stored groups and links; similarity is null where nobody has computed it yet.

    Small components are swept side by side; large ones go through ``rounds`` first.
    """
    kind = groups.schema["id"].dataType.simpleString()
    one = F.count(F.lit(1))
    of_twins = links.filter(~F.col("whole")).groupBy("rep").agg(one.alias("dt"))
    of_clump = links.filter("whole").groupBy("clump").agg(one.alias("dc"))
    n_groups = groups.count()
    known = join_to_unique(groups, of_twins, ["rep"], "left", n_rows=n_groups)
    known = join_to_unique(known, of_clump, ["clump"], "left", n_rows=n_groups)
    degree = F.coalesce("dt", F.lit(0)) + F.coalesce("dc", F.lit(0))
    # images alone in their clump and without a link are never paired
    active = save_table(
        known.withColumn("degree", degree).filter((F.col("copies") > 1) | (F.col("degree") > 0))
        .select("id", "rep", "clump", "degree"),
        "active",
    )
    n_links, n_active = links.count(), active.count()
    out = f"moved {kind}, kept {kind}, similarity double"

    def sweep_whole(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=["moved", "kept", "similarity"])
        swept = _sweep_group(a.assign(was=False), e)
        return swept[swept["kept"].notna()][["moved", "kept", "similarity"]]

    if n_links + n_active <= task_rows:  # the whole graph is within the bound of one task
        whole = F.lit(0).alias("comp")
        return (
            active.select("*", whole).groupBy("comp")
            .cogroup(links.select("*", whole).groupBy("comp"))
            .applyInPandas(sweep_whole, out)
        )
    between = links.filter(F.col("clump") < F.col("other_clump")).select(
        F.col("clump").alias("earlier"), F.col("other_clump").alias("later")
    ).distinct()
    comps = save_table(
        connected_components(between).select(F.col("node").alias("clump"), "comp"), "components"
    )
    active = save_table(
        join_to_unique(active, comps, ["clump"], "left", n_rows=n_active)
        .withColumn("comp", F.coalesce("comp", "clump")),
        "active",
    )
    links = save_table(join_to_unique(links, comps, ["clump"], n_rows=n_links), "links")
    load = (
        active.groupBy("comp").agg(one.alias("n"))
        .unionByName(links.groupBy("comp").agg(one.alias("n")))
        .groupBy("comp").agg(F.sum("n").alias("n"))
    )
    large = save_table(load.filter(F.col("n") > task_rows).select("comp"), "large")
    # at most (arrivals + links) / task_rows components are large
    small_rows = active.join(F.broadcast(large), "comp", "left_anti")
    small_links = links.join(F.broadcast(large), "comp", "left_anti")
    small = small_rows.groupBy("comp").cogroup(small_links.groupBy("comp")).applyInPandas(sweep_whole, out)
    if not large.head(1):
        return small
    rest = (_match_large if rounds else _sweep_large)(
        save_table(active.join(F.broadcast(large), "comp", "left_semi"), "large"),
        save_table(links.join(F.broadcast(large), "comp", "left_semi"), "large"),
        kind,
        task_rows,
    )
    return small.unionByName(rest)


def _merged_groups(
    groups: DataFrame, distinct: DataFrame, threshold: float, sizes: dict
) -> tuple[DataFrame, DataFrame]:
    """Groups and links after merging twins; ``groups`` (id, rep) of equal vectors come in."""
    twins, links = twin_groups(distinct, threshold, **sizes)
    of_first = twins.select(F.col("id").alias("rep"), F.col("rep").alias("twin"), "clump")
    joined = join_to_unique(groups.select("id", "rep"), of_first, ["rep"], n_rows=groups.count())
    moved = save_table(joined.select("id", F.col("twin").alias("rep"), "clump"), "groups")
    copies = save_table(moved.groupBy("clump").agg(F.count(F.lit(1)).alias("copies")), "copies")
    merged = save_table(join_to_unique(moved, copies, ["clump"], weight="copies"), "groups")
    return merged, links.withColumn("similarity", F.lit(0.0))


def greedy_similar_pairs(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float,
    task_rows: int = TASK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    dense_links: float = DENSE_LINKS,
    listed_links: float = LISTED_LINKS,
    **sizes: int,
) -> DataFrame:
    """Stored (moved, kept, similarity): each image is in at most one pair.

    Vectors with ``dense_links`` partners or more in the mean are visited in chunks (``arrivals``), and so are those with
    ``listed_links`` or more within the reach of the clumps, all of which a list would start from. Else links are listed;
    twins are merged first, so that a large group of near copies has no quadratic number of edges.
    """
    threshold = check_threshold(threshold)
    vectors, groups, distinct, n_distinct = equal_groups(df, id_col, vec_col)
    partners, listed = mean_links(distinct, (threshold, reach_of(threshold)), n_distinct)
    if partners >= dense_links or listed >= listed_links:
        return match_arrivals(vectors, threshold, groups.count(), chunk_rows, sizes.get("block_rows", BLOCK_ROWS))
    groups, links = _merged_groups(groups, distinct, threshold, sizes)
    pairs = save_table(match_groups(groups, links, task_rows).select("moved", "kept"), "pairs")
    left = vectors.select(F.col("id").alias("moved"), F.col("vec").alias("mv"))
    right = vectors.select(F.col("id").alias("kept"), F.col("vec").alias("kv"))
    return save_table(
        pairs.join(left, "moved").join(right, "kept").select(
            "moved", "kept", cosine(F.col("mv"), F.col("kv")).alias("similarity")
        ),
        "pairs",
    )


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Add pair_no 1..n in the order of the moved image, to stored pairs."""
    return ordered_rank(pairs, ["moved"], name="pair_no", n_slices=max(1, -(-pairs.count() // TASK_ROWS)))
