"""Preference pairs: the common turns of two conversations as prompt, the rest as completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def one_per_turn(turns: DataFrame) -> DataFrame:
    """(pair_id, turn, said): of rows repeated for a turn the smallest (role, text) counts."""
    return turns.filter("pair_id IS NOT NULL AND turn IS NOT NULL").groupBy("pair_id", "turn").agg(
        F.min(F.struct("role", "text")).alias("said")
    )


def preference_segments(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per rendered turn of each pair; both inputs have pair_id, turn, role, text.

    The turns before the first one in which the two conversations differ (role, text or
    presence) form the part ``prompt``, once per pair; the remaining turns are the parts
    ``chosen`` and ``rejected``. ``rendered`` is the turn with its role marks. Characters
    [mask_start, mask_end) of it are trained on: text and closing mark of ``trained_role`` in a
    completion, none elsewhere. Concatenating ``rendered`` by turn gives prompt and completions.

    Turns are the rows, so no task needs a conversation as a whole, however long it is. Rows
    without pair or turn take no part; of rows repeated for a turn the smallest counts; null
    roles and texts are equal to each other and rendered empty; pairs that are equal
    throughout have a prompt only; a pair given on one side has an empty prompt.
    """
    both = one_per_turn(chosen).withColumnRenamed("said", "c").join(
        one_per_turn(rejected).withColumnRenamed("said", "r"), ["pair_id", "turn"], "full"
    )
    differ = both.filter(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("split"))
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    sides = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said")))).otherwise(
        F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said")),
            F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said")),
        )
    )
    rows = both.join(differ, "pair_id", "left").select("pair_id", "turn", F.inline(sides))
    rows = rows.filter("said IS NOT NULL").select("pair_id", "part", "turn", "said.role", "said.text")
    top = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE))
    rendered = F.concat(top, F.coalesce("text", F.lit("")), F.lit(CLOSE))
    trained = (F.col("part") != "prompt") & F.col("role").eqNullSafe(F.lit(trained_role))
    return rows.select(
        "pair_id", "part", "turn", "role", rendered.alias("rendered"),
        F.when(trained, F.length(top)).otherwise(0).alias("mask_start"),
        F.when(trained, F.length(rendered)).otherwise(0).alias("mask_end"),
    )


def preference_rows(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected and the trained (start, end) spans of both.

    For conversations that fit a row; ``preference_segments`` has no such bound.
    """
    turn = F.struct("turn", "rendered", "mask_start", "mask_end")
    per_part = segments.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, x):
        span = F.struct((acc["at"] + x["mask_start"]).alias("start"), (acc["at"] + x["mask_end"]).alias("end"))
        spans = F.when(x["mask_end"] > 0, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(x["rendered"])).alias("at"), spans.alias("spans"))

    parts = per_part.select(
        "pair_id", "part", F.array_join(F.transform("turns", lambda x: x["rendered"]), "").alias("text"),
        F.aggregate("turns", start, add, lambda acc: acc["spans"]).alias("spans"),
    )

    def of(part: str, column: str):
        return F.max(F.when(F.col("part") == part, F.col(column)))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return parts.groupBy("pair_id").agg(
        *[F.coalesce(of(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")],
        *[F.coalesce(of(p, "spans"), none).alias(f"{p}_mask") for p in ("chosen", "rejected")],
    )


def stale_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns made of whole conversations (conv_id, turn, role, text).

    Chosen is the conversation itself. Rejected is the same with the last assistant turn
    answered by the text of the assistant turn before it (empty if there is none) and without
    the turns after it. Conversations without an assistant turn form no pair.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    said = turns.filter("role = 'assistant' AND pair_id IS NOT NULL AND turn IS NOT NULL")
    last = said.groupBy("pair_id").agg(F.max("turn").alias("last"))
    before = said.join(last, "pair_id").filter("turn < last").groupBy("pair_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"].alias("stale")
    )
    ends = last.join(before, "pair_id", "left").select("pair_id", "last", F.coalesce("stale", F.lit("")).alias("stale"))
    kept = turns.join(ends, "pair_id")
    text = F.when(F.col("turn") == F.col("last"), F.col("stale")).otherwise(F.col("text"))
    rejected = kept.filter("turn <= last").select("pair_id", "turn", "role", text.alias("text"))
    return kept.select("pair_id", "turn", "role", "text"), rejected


PREFERENCE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS rn
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE rn = 1),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT t.conv_id, arg_max(coalesce(t.text, ''), t.turn) AS stale FROM t JOIN l USING (conv_id)
      WHERE t.role = 'assistant' AND t.turn < l.last GROUP BY 1),
k AS (SELECT t.*, l.last, CASE WHEN t.turn = l.last THEN coalesce(p.stale, '') ELSE t.text END AS other
      FROM t JOIN l USING (conv_id) LEFT JOIN p USING (conv_id)),
d AS (SELECT conv_id, min(turn) AS split FROM k
      WHERE turn > last OR text IS DISTINCT FROM other GROUP BY 1),
s AS (
  SELECT conv_id, 'prompt' AS part, turn, role, text FROM k LEFT JOIN d USING (conv_id) WHERE split IS NULL OR turn < split
  UNION ALL SELECT conv_id, 'chosen', turn, role, text FROM k JOIN d USING (conv_id) WHERE turn >= split
  UNION ALL SELECT conv_id, 'rejected', turn, role, other FROM k JOIN d USING (conv_id)
  WHERE turn >= split AND turn <= last)
SELECT conv_id AS pair_id, part, turn, role,
  '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length('{OPEN}' || role) + 1 ELSE 0 END AS INTEGER) AS mask_start,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant'
    THEN length('{OPEN}' || role || coalesce(text, '')) + 12 ELSE 0 END AS INTEGER) AS mask_end
FROM s
"""
