"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only (operator 1).

A logged conversation is often stored again at each turn. Each turn gets a hash bound to its position, role and text; the
running sums of these are rolling turn-prefix hashes. A conversation whose whole hash is a proper prefix hash of another
one is a snapshot of it and leaves by an anti-join; equal conversations keep the smallest conv_id. What is left is
rendered. Positions and sums are built in two levels (blocks of turns, then block totals), so that a conversation with
very many turns is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import written

BLOCK = 64  # turn numbers in a block of the two-level sums
PART = 256  # turns in a rendered row


def placed_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, ...) -> (conv_id, block, pos, n, role, text, x1, x2): pos from 1, n turns in all, and
    two hashes of each turn. The rows are written once; what reads hashes alone doesn't read texts."""
    rows = (
        turns.where("conv_id is not null")
        .select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    )
    inner = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("c")).select("conv_id", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(all_blocks).alias("n"))
    placed = rows.withColumn("own", F.row_number().over(inner)).join(counts, ["conv_id", "block"]).withColumn("pos", F.col("base") + F.col("own"))
    return written(placed.select("conv_id", "block", "pos", "n", "role", "text", F.xxhash64("pos", "role", "text").alias("x1"), F.xxhash64(F.lit("second"), "pos", "role", "text").alias("x2")))


def turn_prefixes(placed: DataFrame) -> DataFrame:
    """placed turns -> (conv_id, pos, n, h1, h2): two independent prefix hashes up to pos. No text is read."""
    hashed = placed.select("conv_id", "block", "pos", "n", *[F.col(x).cast("decimal(20,0)").alias(x) for x in ("x1", "x2")])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("conv_id", "block").orderBy("pos")
    sums = hashed.groupBy("conv_id", "block").agg(F.sum("x1").alias("s1"), F.sum("x2").alias("s2"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"b{k}") for k in (1, 2)])
    running = hashed.withColumn("r1", F.sum("x1").over(inner)).withColumn("r2", F.sum("x2").over(inner)).join(sums, ["conv_id", "block"])
    return running.select("conv_id", "pos", "n", *[(F.col(f"b{k}") + F.col(f"r{k}")).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)])


def collapse(prefixes: DataFrame) -> DataFrame:
    """-> (conv_id, n_turns, n_copies): one row for each maximal conversation."""
    whole = prefixes.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = prefixes.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, ...) -> (conv_id, part, n_turns, n_copies, rendered).

    A maximal conversation is rendered in rows of PART turns (part from 0). Repeated rows count once; turns of one number
    are ordered by role and text; a null turn comes first, a null role is `unknown`, a null text empty, rows without
    conv_id are left out. Extra columns are ignored. Empty table: empty result.
    """
    placed = placed_turns(turns)
    kept = collapse(turn_prefixes(placed))
    # Texts meet by conversation and part, so a conversation of very many turns is no hot key.
    parts = kept.select("conv_id", "n_turns", "n_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / PART))).alias("part"))
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    lines = placed.select("conv_id", F.floor((F.col("pos") - 1) / PART).alias("part"), "pos", line.alias("line")).join(parts, ["conv_id", "part"])
    grouped = lines.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))
