"""Greedy matching of a large component in rounds, all of it at once.

Visiting the images one by one takes, among the remaining links, the one whose later image comes first, with the
earliest partner. A link that is the first one left at both of its ends is taken whatever happens elsewhere, so
all such links can be taken in one round; what they touch is dropped, and the rest is a smaller
instance of the same task. In terms of images: two images are paired if each is the first of the
other's remaining neighbours.

Links join twin groups and clumps, not images (see ``matching``), so a round only looks at the first
image of each group and the first two of each clump: nobody else can be the first neighbour of
anyone. Links between images are never listed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.skew import join_to_unique
from framesift.session import save_table

LEAST_SHARE = 0.02  # of the images a round has to pair; long chains pair a few only and are better swept
MAX_ROUNDS = 60


class Rounds(NamedTuple):
    pairs: DataFrame | None  # (moved, kept) taken so far
    images: DataFrame  # (id, rep, clump) that are left
    links: DataFrame  # the links between those
    n_rounds: int
    stalled: bool


def first_neighbours(images: DataFrame, links: DataFrame, n_images: int, n_links: int) -> DataFrame:
    """Stored (id, first): the lowest remaining neighbour of the images that can be in a pair of this round."""
    heads = save_table(images.groupBy("rep", "clump").agg(F.min("id").alias("id")), "heads")
    place = F.row_number().over(Window.partitionBy("clump").orderBy("id"))
    # the rank filter keeps two rows per clump and task before the shuffle
    ranked = images.withColumn("_place", place).filter("_place <= 2")
    two = save_table(
        ranked.groupBy("clump").agg(
            F.min("id").alias("one"), F.min(F.when(F.col("_place") == 2, F.struct("id", "rep"))).alias("two")
        ),
        "two",
    )
    of_twins = links.filter(~F.col("whole")).select("rep", "other")
    of_twins = join_to_unique(of_twins, heads.select(F.col("rep").alias("other"), F.col("id").alias("near")), ["other"], n_rows=n_links)
    of_twins = of_twins.groupBy("rep").agg(F.min("near").alias("by_twins"))
    of_clump = links.filter("whole").select("clump", "other_clump")
    of_clump = join_to_unique(of_clump, two.select(F.col("clump").alias("other_clump"), F.col("one").alias("near")), ["other_clump"], n_rows=n_links)
    of_clump = of_clump.groupBy("clump").agg(F.min("near").alias("by_clump"))
    seconds = two.filter("two IS NOT NULL").select("two.rep", "clump", "two.id")
    able = heads.unionByName(seconds).distinct()
    able = join_to_unique(able, of_twins, ["rep"], "left", n_rows=n_images)
    able = join_to_unique(able, of_clump, ["clump"], "left", n_rows=n_images)
    able = join_to_unique(able, two, ["clump"], n_rows=n_images)
    inside = F.when(F.col("id") == F.col("one"), F.col("two.id")).otherwise(F.col("one"))
    return save_table(able.select("id", F.least("by_twins", "by_clump", inside).alias("first")).filter("first IS NOT NULL"), "first")


def match_rounds(images: DataFrame, links: DataFrame, enough: int, max_rounds: int = MAX_ROUNDS, least_share: float = LEAST_SHARE) -> Rounds:
    """Rounds over stored ``images`` (id, rep, clump) and ``links`` until what is left counts ``enough`` rows or less.

    ``stalled`` tells that a round paired less than ``least_share`` of the images: each image waits
    for the one before it, as in a long chain, and rounds would take as many passes as the chain is long.
    """
    images, found, stalled = images.select("id", "rep", "clump"), None, False
    number, n_images, n_links = 0, images.count(), links.count()
    while n_images + n_links > enough and number < max_rounds and not stalled:
        number += 1
        first = first_neighbours(images, links, n_images, n_links)
        back = first.select(F.col("first").alias("id"), F.col("id").alias("first"))
        pairs = first.join(back, ["id", "first"]).filter("id < first")
        pairs = save_table(pairs.select(F.col("first").alias("moved"), F.col("id").alias("kept")), "round")
        gone = pairs.select(F.col("moved").alias("id")).unionByName(pairs.select(F.col("kept").alias("id")))
        images = save_table(images.join(gone, "id", "left_anti"), "images")
        reps, clumps = images.select("rep").distinct(), images.select("clump").distinct()
        twins = links.filter(~F.col("whole")).join(reps, "rep", "left_semi").join(reps.withColumnRenamed("rep", "other"), "other", "left_semi")
        whole = links.filter("whole").join(clumps, "clump", "left_semi").join(clumps.withColumnRenamed("clump", "other_clump"), "other_clump", "left_semi")
        links = save_table(twins.unionByName(whole), "links")
        before, n_images, n_links = n_images, images.count(), links.count()
        stalled = before - n_images < least_share * before or before == n_images
        found = pairs if found is None else save_table(found.unionByName(pairs), "found")
    return Rounds(found, images, links, number, stalled)
