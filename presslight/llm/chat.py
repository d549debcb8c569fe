"""Chat formatting by collapse of cumulative snapshots, with native Spark functions only.

Logs often hold a conversation several times, each time with more turns. Every turn gets the rolling
hash of the turns up to it (the xor of hashes of position, role and text; two of 64 bits). A
conversation whose last rolling hash is that of an earlier turn in another, longer conversation is a
prefix of it; an anti-join leaves the maximal ones, and of equal ones the smallest id. These are
then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_key

#: Turn numbers of one block; blocks keep a conversation of any length from being one task's or one row's load.
BLOCK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> the turns of maximal conversations, with position, part, copies.

    Turns stand in the order of turn (null last), role, text; a turn row that is repeated in full
    counts once. Rows with a null conv_id are one conversation. Null role and text equal only null.
    A conversation equal to another in all turns counts as its copy; the smallest conv_id stays
    (null after all ids) with the number of copies. position counts from 1; part is the block of turn numbers.
    """
    rows = (
        turns.select("conv_id", "turn", "role", "text")
        .distinct()
        .withColumns({"_conv": id_key(F.col("conv_id")), "part": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long")})
    )
    ordered = W.partitionBy("_conv", "part").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    earlier = W.partitionBy("_conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_conv")

    sizes = rows.groupBy("_conv", "part").agg(F.count("*").alias("_n"), F.first("conv_id").alias("conv_id"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "n_turns": F.sum("_n").over(whole)}).drop("_n", "conv_id")
    numbered = rows.withColumn("_in", F.row_number().over(ordered)).join(sizes, ["_conv", "part"]).withColumn("position", F.col("_before") + F.col("_in"))
    words = [id_key(F.col("role")), id_key(F.col("text"))]
    hashed = numbered.withColumns({"_h1": F.xxhash64("position", *words), "_h2": F.xxhash64(*reversed(words), F.lit(1), "position")})

    blocks = hashed.groupBy("_conv", "part").agg(F.bit_xor("_h1").alias("_b1"), F.bit_xor("_h2").alias("_b2"), F.first("n_turns").alias("n_turns"), F.first("conv_id").alias("conv_id"))
    totals = blocks.groupBy("_conv").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.bit_xor("_b1").alias("h1"), F.bit_xor("_b2").alias("h2"))
    starts = blocks.select("_conv", "part", *(F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(f"_s{b[-1]}") for b in ("_b1", "_b2")))
    running = W.partitionBy("_conv", "part").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rolling = hashed.withColumns({"_r1": F.bit_xor("_h1").over(running), "_r2": F.bit_xor("_h2").over(running)}).join(starts, ["_conv", "part"])
    prefixes = (
        rolling.filter(F.col("position") < F.col("n_turns"))
        .select(F.col("position").alias("n_turns"), F.expr("_r1 ^ _s1").alias("h1"), F.expr("_r2 ^ _s2").alias("h2"))
        .distinct()
    )
    different = totals.groupBy("n_turns", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "_conv"))["_conv"].alias("_conv"), F.count("*").alias("copies"))
    maximal = different.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("_conv", "copies")
    stay = sizes.select("_conv", "part").join(maximal, "_conv")
    return numbered.join(stay, ["_conv", "part"]).select("conv_id", "turn", "role", "text", "position", "part", "n_turns", "copies", "_conv")


def render_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns, copies, first_position, rendered.

    A turn renders as <|im_start|>role, newline, text, <|im_end|>, newline; a null role as
    `unknown`, a null text as nothing. The two marks in a role or text lose their first bar, so that
    content can't open or close a turn. A conversation longer than a block of turn numbers comes in several
    parts, whose texts in order of first_position make the whole.
    """
    plain = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<$1|>")
    piece = F.concat(F.lit(OPEN), plain(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), plain(F.coalesce("text", F.lit(""))), F.lit(CLOSE + "\n"))
    parts = collapse_snapshots(turns).groupBy("_conv", "part").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("n_turns").alias("n_turns"),
        F.first("copies").alias("copies"),
        F.min("position").alias("first_position"),
        F.array_sort(F.collect_list(F.struct("position", piece.alias("piece")))).alias("_pieces"),
    )
    return parts.select("conv_id", "part", "n_turns", "copies", "first_position", F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("rendered"))


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return render_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS position,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (SELECT *, string_agg(coalesce('r' || md5(role), 'n') || coalesce('t' || md5(text), 'n'), ',') OVER (
               PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS prefix FROM n),
f AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE position = n_turns GROUP BY prefix),
m AS (SELECT conv_id, copies FROM f WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < n_turns)),
k AS (SELECT n.*, copies, coalesce(turn // 1024, 4611686018427387904) AS part FROM n JOIN m ON n.conv_id IS NOT DISTINCT FROM m.conv_id)
SELECT conv_id, part, any_value(n_turns) AS n_turns, any_value(copies) AS copies, min(position) AS first_position,
       string_agg('<|im_start|>' || regexp_replace(coalesce(role, 'unknown'), '<\|(im_start|im_end)\|>', '<\1|>', 'g') || chr(10)
                  || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1|>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
FROM k GROUP BY conv_id, part
"""
