"""Groups of near copies that act as one in greedy matching.

A large group of near copies has a quadratic number of similar pairs, yet matching needs
only to know which vectors have the same similar partners. Such twins are found without
listing pairs:

1. Vectors that share a coarse projection key and lie within a small angle of the first of
   them form a clump. A clump is far narrower than the threshold angle, so all its members
   are similar to each other.
2. Only the first members of clumps are compared. If two clumps are clearly nearer, or
   clearly farther, than the threshold whatever their radius, that holds for all members.
3. For the remaining pairs of clumps the members are compared block by block, and each
   member keeps a checksum of its partners, not the partners. Members of a clump with equal
   checksums are twins.

The grouping only decides how much is saved; the matching stays exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framesift.functions.vectors import cosine
from framesift.operators.similarity import BLOCK_ROWS, distinct_pairs, unit_rows
from framesift.operators.skew import join_to_unique
from framesift.session import save_table

PROJECTIONS = 6
RADIUS_SHARE = 1 / 8  # clump radius as a share of the threshold angle
SLACK = 1e-7


def reach_of(threshold: float) -> float:
    """The similarity down to which first members of clumps are compared and listed."""
    theta = math.acos(threshold)
    return math.cos(min(theta * (1 + 2 * RADIUS_SHARE) + SLACK, math.pi - SLACK))


def _key_udf(width: int, radius: float):
    directions = np.random.default_rng(7).normal(size=(width, PROJECTIONS))

    @F.pandas_udf("array<int>")
    def key(vec: pd.Series) -> pd.Series:
        cells = np.floor(unit_rows(np.stack(vec.to_numpy())) @ directions / (2 * radius))
        return pd.Series(list(cells.astype("int32")))

    return key


def clumps(vectors: DataFrame, width: int, radius: float) -> DataFrame:
    """Stored (id, clump, angle): clump is the id of its first member, angle the way to it."""
    keyed = save_table(vectors.withColumn("key", _key_udf(width, radius)("vec")), "keyed")
    heads = (
        keyed.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )
    head_vectors = vectors.select(F.col("id").alias("head"), F.col("vec").alias("head_vec"))
    heads = save_table(heads.join(head_vectors, "head"), "heads")
    near = F.acos(F.least(cosine(F.col("vec"), F.col("head_vec")), F.lit(1.0)))
    at = F.when(F.col("id") == F.col("head"), F.lit(0.0)).otherwise(near)
    joined = join_to_unique(keyed, heads, ["key"], "left", weight="n").select("id", "head", at.alias("angle"))
    inside = F.col("head").isNotNull() & (F.col("angle") <= radius)
    return save_table(
        joined.select(
            "id", F.when(inside, F.col("head")).otherwise(F.col("id")).alias("clump"),
            F.when(inside, F.col("angle")).otherwise(F.lit(0.0)).alias("angle"),
        ),
        "clumps",
    )


def _compare_clumps(heads: DataFrame, wide: DataFrame, threshold: float, sizes: dict) -> DataFrame:
    """Stored (a, b, sure): pairs of clumps that are similar for sure, or have to be looked into."""
    theta = math.acos(threshold)
    pairs = save_table(distinct_pairs(heads, reach_of(threshold), heads.count(), **sizes), "heads")
    n_pairs = pairs.count()
    of_a = wide.select(F.col("clump").alias("earlier"), F.col("radius").alias("ra"))
    of_b = wide.select(F.col("clump").alias("later"), F.col("radius").alias("rb"))
    both = join_to_unique(pairs, of_a, ["earlier"], "left", n_rows=n_pairs)
    both = join_to_unique(both, of_b, ["later"], "left", n_rows=n_pairs)
    spread = F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))
    point = F.col("ra").isNull() & F.col("rb").isNull()
    angle = F.acos(F.least(F.col("similarity"), F.lit(1.0)))
    sure = F.when(point, F.col("similarity") > threshold).otherwise(angle + spread < theta - SLACK)
    unsure = ~point & ~sure & (angle - spread < theta + SLACK)
    return save_table(
        both.filter(sure | unsure).select(F.col("earlier").alias("a"), F.col("later").alias("b"), sure.alias("sure")),
        "verdicts",
    )


def _checksum_kernel(threshold: float, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("x", pa.int64()), ("s", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = unit_rows(flat.reshape(table.num_rows, -1))
        owner = table.column("is_owner").to_numpy(zero_copy_only=False).astype(bool)
        code = table.column("code").to_numpy()
        own, other = np.flatnonzero(owner), np.flatnonzero(~owner)
        if not len(own) or not len(other):
            return schema.empty_table()
        x, s, n = (np.zeros(len(owner), dtype=np.int64) for _ in range(3))
        for at in range(0, len(own), 1024):
            part = own[at : at + 1024]
            hit = unit[part] @ unit[other].T > threshold
            x[part] = np.bitwise_xor.reduce(np.where(hit, code[other][None, :], 0), axis=1)
            x[other] ^= np.bitwise_xor.reduce(np.where(hit, code[part][:, None], 0), axis=0)
            mixed = (code >> 24) & 0xFFFFFFFF
            s[part] = hit @ mixed[other]
            s[other] += mixed[part] @ hit
            n[part] = hit.sum(axis=1)
            n[other] += hit.sum(axis=0)
        seen = np.flatnonzero(n)
        return pa.Table.from_arrays(
            [ids.take(pa.array(seen)), pa.array(x[seen]), pa.array(s[seen]), pa.array(n[seen])], schema=schema
        )

    return run


def _partner_checksums(
    members: DataFrame, vectors: DataFrame, wide: DataFrame, unsure: DataFrame, threshold: float, block_rows: int
) -> DataFrame:
    """(id, x, s, n) of members with a partner in a clump they have to be compared with.

    Each pair of clumps belongs to the larger one. The members of an owner are compared with
    all members of its partner clumps, block against block.
    """
    size = wide.select("clump", "size")
    n_unsure, n_members = unsure.count(), members.count()
    sized = join_to_unique(unsure, size.withColumnsRenamed({"clump": "a", "size": "na"}), ["a"], "left", n_rows=n_unsure)
    sized = join_to_unique(sized, size.withColumnsRenamed({"clump": "b", "size": "nb"}), ["b"], "left", n_rows=n_unsure)
    a_owns = F.coalesce("na", F.lit(1)) >= F.coalesce("nb", F.lit(1))
    owned = save_table(
        sized.select(
            F.when(a_owns, F.col("a")).otherwise(F.col("b")).alias("owner"),
            F.when(a_owns, F.col("b")).otherwise(F.col("a")).alias("clump"),
        ),
        "owned",
    )
    owners = owned.select("owner").distinct().select("owner", F.col("owner").alias("clump"), F.lit(True).alias("is_owner"))
    roles = save_table(owned.withColumn("is_owner", F.lit(False)).unionByName(owners), "roles")
    # a member takes part in each role of its clump; a clump may be hot
    cast = save_table(
        join_to_unique(members.select("id", "clump"), roles, ["clump"], n_rows=n_members).select("owner", "is_owner", "id"),
        "cast",
    )
    counts = cast.groupBy("owner").agg(
        F.ceil(F.count_if("is_owner") / F.lit(block_rows)).cast("int").alias("_own"),
        F.ceil(F.count_if(~F.col("is_owner")) / F.lit(block_rows)).cast("int").alias("_oth"),
        F.count(F.lit(1)).alias("_n"),
    )
    placed = join_to_unique(cast, save_table(counts, "counts"), ["owner"], weight="_n")
    mine = F.when(F.col("is_owner"), F.col("_own")).otherwise(F.col("_oth"))
    theirs = F.when(F.col("is_owner"), F.col("_oth")).otherwise(F.col("_own"))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("id"), mine)).withColumn(
        "_meets", F.explode(F.sequence(F.lit(0), theirs - 1))
    )
    tasks = placed.select(
        "owner", "is_owner", "id", F.xxhash64("id", F.lit(11)).alias("code"),
        F.when(F.col("is_owner"), F.col("_block")).otherwise(F.col("_meets")).alias("left"),
        F.when(F.col("is_owner"), F.col("_meets")).otherwise(F.col("_block")).alias("right"),
    ).join(vectors, "id")
    id_type = vectors.schema["id"].dataType
    kernel = _checksum_kernel(threshold, to_arrow_type(id_type))
    partial = tasks.groupBy("owner", "left", "right").applyInArrow(
        kernel, f"id {id_type.simpleString()}, x long, s long, n long"
    )
    return partial.groupBy("id").agg(F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.sum("n").alias("n"))


def twin_groups(
    vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, **sizes: int
) -> tuple[DataFrame, DataFrame]:
    """Stored (twins, links) over stored distinct ``vectors`` (id, vec).

    twins: (id, rep, clump); rep is the first of the twins. links: see ``links_between``.
    """
    radius = math.acos(threshold) * RADIUS_SHARE
    first = vectors.first()
    width = len(first["vec"]) if first else 1
    members = clumps(vectors, width, radius)
    wide = save_table(
        members.groupBy("clump").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1),
        "wide",
    )
    firsts = members.filter(F.col("id") == F.col("clump")).select("id")
    heads = save_table(vectors.join(firsts, "id", "left_semi"), "heads")
    verdicts = _compare_clumps(heads, wide, threshold, {"block_rows": block_rows, **sizes})
    unsure = verdicts.filter(~F.col("sure")).select("a", "b")
    if unsure.head(1):
        sums = save_table(_partner_checksums(members, vectors, wide, unsure, threshold, block_rows), "sums")
        signed = save_table(members.join(sums, "id", "left").select("id", "clump", "x", "s", "n"), "signed")
        # nulls do not join: members without partners form one group per clump
        sign = [F.coalesce(c, F.lit(0)).alias(c) for c in ("x", "s", "n")]
        signed = signed.select("id", "clump", *sign)
        twins = signed.groupBy("clump", "x", "s", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
        twins = save_table(twins, "twins")
        groups = join_to_unique(signed, twins, ["clump", "x", "s", "n"], weight="size").select("id", "rep", "clump")
        reps = twins.select("clump", "rep")
    else:
        groups = members.select("id", F.col("clump").alias("rep"), "clump")
        reps = members.filter(F.col("id") == F.col("clump")).select("clump", F.col("id").alias("rep"))
    groups, reps = save_table(groups, "groups"), save_table(reps, "reps")
    left = reps.select(F.col("clump").alias("a"), F.col("rep").alias("p"))
    right = reps.select(F.col("clump").alias("b"), F.col("rep").alias("q"))
    half = save_table(join_to_unique(unsure, left, ["a"], n_rows=unsure.count()), "open")
    both = join_to_unique(half, right, ["b"], n_rows=half.count())
    pv = vectors.select(F.col("id").alias("p"), F.col("vec").alias("pv"))
    qv = vectors.select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    checked = (
        both.join(pv, "p").join(qv, "q").filter(cosine(F.col("pv"), F.col("qv")) > threshold).select("a", "b", "p", "q")
    )
    sure = verdicts.filter("sure").select("a", "b")
    return groups, links_between(sure, save_table(checked, "checked"))


def links_between(sure: DataFrame, checked: DataFrame) -> DataFrame:
    """Stored links in both directions: (clump, rep, other_clump, other, whole).

    ``whole`` links hold for every member of both clumps and name the clumps only; the
    others hold between two groups of twins. Members of one clump need no link.
    """
    w = sure.select(
        F.col("a").alias("clump"), F.col("a").alias("rep"), F.col("b").alias("other_clump"),
        F.col("b").alias("other"), F.lit(True).alias("whole"),
    )
    c = checked.select(
        F.col("a").alias("clump"), F.col("p").alias("rep"), F.col("b").alias("other_clump"),
        F.col("q").alias("other"), F.lit(False).alias("whole"),
    )
    one = w.unionByName(c)
    back = one.select(
        F.col("other_clump").alias("clump"), F.col("other").alias("rep"),
        F.col("clump").alias("other_clump"), F.col("rep").alias("other"), "whole",
    )
    return save_table(one.unionByName(back), "links")
