"""Chat formatting: cumulative snapshots of a conversation are collapsed before rendering.

Logs often hold a conversation several times, each time some turns longer. A conversation that is the beginning of a longer
one, or equal to another, is left out: every turn carries the rolling hash of the turns up to it (two 64-bit
hashes of place, role and text, joined by exclusive or, so a prefix's hash is a running sum). The hash of a whole
conversation is looked up among the distinct hashes of proper prefixes by an anti join; equal conversations are
reduced to the smallest id. What remains is rendered as one text with turn marks.

Only DataFrame functions run. Prefixes and whole conversations are made distinct before they meet, so a first turn or a
conversation that a third of all logs share is one row there. Turns meet by conversation only.

Defined cases: turns are put in order by turn number, then role and text (null numbers last); a null role is ``unknown``, a
null text empty; repeated rows are turns of their own; rows without a conv_id are left out; turn marks inside a text are
broken by a blank, so that a text cannot open a turn; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, h1, h2 (rolling hashes) and last (whether it is the last turn)."""
    order = [F.asc_nulls_last("turn"), "role", "text"]
    within = Window.partitionBy("conv_id").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    clean = turns.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = clean.withColumn("place", F.row_number().over(within)).withColumn(
        "last", F.lead(F.lit(1)).over(within).isNull())
    one, two = F.xxhash64("place", "role", "text"), F.xxhash64(F.lit("second"), "place", "role", "text")
    return placed.select(
        "conv_id", "place", "role", "text", "last",
        F.bit_xor(one).over(running).alias("h1"), F.bit_xor(two).over(running).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and turns of the conversations that neither begin a longer one nor repeat one with a smaller id."""
    hashed = with_prefix_hashes(turns)
    key = ["place", "h1", "h2"]
    whole = hashed.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.filter("not last").select(*key).distinct()
    return whole.join(prefixes, key, "left_anti").select("conv_id", F.col("place").cast("bigint").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of the maximal conversations."""
    kept = maximal(turns)
    safe = lambda x: F.replace(F.replace(x, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    line = F.concat(F.lit(OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(CLOSE + "\n"))
    lines = with_prefix_hashes(turns).join(kept, "conv_id").select(
        "conv_id", "n_turns", F.struct("place", line.alias("line")).alias("turn"))
    return lines.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list("turn")).alias("lines")).select(
        "conv_id", "n_turns", F.array_join(F.col("lines")["line"], "").alias("rendered"))


#: The same in SQL: conversations as lists of turns, prefixes as slices of these lists.
RENDER_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS said, count(*) AS n_turns FROM turns GROUP BY conv_id
), firsts AS (
    SELECT min(conv_id) AS conv_id, said, n_turns FROM whole GROUP BY said, n_turns
), prefixes AS (
    SELECT DISTINCT said[1:n] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS n FROM whole)
), kept AS (
    SELECT conv_id, n_turns FROM firsts WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE prefixes.said = firsts.said)
)
SELECT conv_id, n_turns, string_agg(
    '<|im_start|>' || replace(replace(role, '<|', '< |'), '|>', '| >') || chr(10)
    || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM turns JOIN kept USING (conv_id) GROUP BY conv_id, n_turns
"""
