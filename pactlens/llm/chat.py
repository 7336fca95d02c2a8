"""Chat formatting: cumulative snapshots collapse into the longest conversation, which is then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of

START, END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its place ``n`` in the conversation, whether it is the last, and the hash of the turns up to it.

    A prefix hash is the exclusive or of two 64-bit hashes of (place, role, text) over the turns so far: 128 bits that a
    window carries from turn to turn without ever holding a conversation.  Turns are ordered by (turn, role, text).
    A row without ``conv_id`` belongs to no other row: it is a conversation of one turn, and in no window.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content = (F.col("n"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = columns_of(turns, "conv_id", "turn", "role", "text")
    alone = rows.where("conv_id IS NULL").withColumn("n", F.lit(1))
    alone = alone.withColumn("h1", F.xxhash64(F.lit(1), *content)).withColumn("h2", F.xxhash64(F.lit(2), *content)).withColumn("is_last", F.lit(True))
    return (
        rows.where("conv_id IS NOT NULL")
        .withColumn("n", F.row_number().over(order))
        .withColumn("h1", F.bit_xor(F.xxhash64(F.lit(1), *content)).over(so_far))
        .withColumn("h2", F.bit_xor(F.xxhash64(F.lit(2), *content)).over(so_far))
        .withColumn("is_last", F.lead("n").over(order).isNull())
        .unionByName(alone)
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, h1, h2, n_copies`` of the conversations that no longer one begins with.

    Of equal conversations the smallest ``conv_id`` stays (a null id counts as the smallest) and
    ``n_copies`` counts them.  A prefix that many conversations share is one row before it is joined.
    """
    whole = (
        prefixes.where("is_last")
        .groupBy("h1", "h2", F.col("n").alias("n_turns"))
        .agg(
            F.min("conv_id").alias("least"),
            F.count(F.when(F.col("conv_id").isNull(), 1)).alias("nulls"),
            F.count("*").alias("n_copies"),
        )
        .select("h1", "h2", "n_turns", "n_copies", F.when(F.col("nulls") == 0, F.col("least")).alias("conv_id"))
    )
    continued = prefixes.where("NOT is_last").select("h1", "h2", F.col("n").alias("n_turns")).distinct()
    return whole.join(continued, ["h1", "h2", "n_turns"], "left_anti")


def escaped(text) -> F.Column:
    """Text in which the two control strings can no longer be read as such: a space follows their ``<``."""
    return F.replace(F.replace(text, F.lit(START), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` of the maximal conversations, in the ChatML form.

    Defined cases: a null role is ``user``, a null text is empty, roles are trimmed and lower-cased for rendering only;
    turns with equal or null numbers are ordered by role and text and all stay; an empty table gives no rows; columns
    beyond the four are ignored; rows without ``conv_id`` are conversations of one turn each, equal ones one row with a
    null id.  A rendered conversation is one value, as every sink of chat data needs it; apart from
    it no step holds a conversation.
    """
    prefixes = turn_prefixes(turns)
    kept = maximal(prefixes)
    role = F.lower(F.trim(F.coalesce("role", F.lit("user"))))
    shown = F.concat(F.lit(START), escaped(role), F.lit("\n"), escaped(F.coalesce("text", F.lit(""))), F.lit(END + "\n"))
    alone = prefixes.where("conv_id IS NULL").groupBy("h1", "h2").agg(F.min(shown).alias("text"))
    alone = kept.where("conv_id IS NULL").join(alone, ["h1", "h2"]).select("conv_id", "n_turns", "n_copies", "text")
    pieces = prefixes.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("of"), F.struct("n", shown.alias("shown")).alias("piece"))
    return (
        pieces.join(kept.where("conv_id IS NOT NULL").drop("h1", "h2"), F.col("of") == F.col("conv_id"))
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        .select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.col("pieces.shown")).alias("text"))
        .unionByName(alone)
    )
