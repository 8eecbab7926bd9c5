"""Chat formatting: cumulative-snapshot collapse, then rendering.

Logged conversations are often snapshots of one that went on: each is a prefix of the next. A rolling hash of
the turns so far stands at every turn; a conversation whose whole hash is also the hash of a proper prefix of
a longer one is dropped by an anti-join, and of equal conversations the one with the least id stays. What is
left is rendered with a chat template, a row for each turn; in order of ``position`` they join up to the whole text
(``conversations`` does that for conversations of a bounded length). Only DataFrame functions are used.

A conversation may hold any share of all rows, so nothing gathers one whole. The different turns, as hashes, are sorted
over range partitions, which cut a long conversation wherever they fill; a turn's place, and the hash so far, are
counted within its chunk (what a partition has of a conversation) and added to the sums of the chunks before. A
conversation has no more chunks than there are partitions.

Defined results: turns are ordered by number (null last), then by a hash of role and text; a repeated row counts
once; a null role reads ``unknown`` and a null text is empty; rows with a null conversation id form one
conversation; template markers in a text are taken apart so that a text can't forge a turn. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import named, saved, spread_join

#: The template's markers.
START, END = "<|im_start|>", "<|im_end|>"

_KEY = ["conv", "turn", "h1", "h2"]


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    conv, turn, role, text = named([conv_col, turn_col, role_col, text_col])
    given = conversations.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return given.select(
        F.struct(F.col("conv_id").isNull().alias("none"), "conv_id").alias("conv"),
        F.struct(F.col("turn").isNull().alias("none"), F.coalesce("turn", F.lit(0)).alias("n")).alias("turn"),
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64("text", F.lit(1), "role").alias("h2"),
        "role",
        "text",
    )


def _before(column: Column) -> Column:
    """Along a conversation, over the chunks before this one."""
    return column.over(Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, turn, h1, h2, position, n, p1, p2)`` for every different turn: its place in the conversation from 1, the
    conversation's length, and the rolling hashes up to the turn."""
    different = saved(turns.select(*_KEY).distinct(), "turns")
    # sorted over all partitions: a row's number is its partition above, its place there below
    ordered = different.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("at", F.monotonically_increasing_id())
    ordered = saved(ordered.withColumn("chunk", F.shiftright("at", 33)), "ordered", instead_of=[different])
    chunks = ordered.groupBy("conv", "chunk").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    bases = chunks.select("conv", "chunk", (F.coalesce(_before(F.sum("many")), F.lit(0)) - F.col("first") + 1).alias("base"), F.sum("many").over(Window.partitionBy("conv")).alias("n"))
    placed = ordered.join(bases, ["conv", "chunk"]).withColumn("position", F.col("base") + F.col("at"))
    # a turn's share depends on its place; shares are joined by exclusive or, so chunks can be joined later
    shares = saved(placed.select(*_KEY, "chunk", "position", "n", F.xxhash64("position", "h1", "h2").alias("s1"), F.xxhash64("h2", "position", "h1").alias("s2")), "shares", instead_of=[ordered])
    whole = shares.groupBy("conv", "chunk").agg(F.bit_xor("s1").alias("w1"), F.bit_xor("s2").alias("w2"))
    so_far = whole.select("conv", "chunk", *[F.coalesce(_before(F.bit_xor(f"w{k}")), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    rolling = Window.partitionBy("conv", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = shares.select(*_KEY, "chunk", "position", "n", *[F.bit_xor(f"s{k}").over(rolling).alias(f"l{k}") for k in (1, 2)])
    joined = local.join(so_far, ["conv", "chunk"])
    return joined.select(*_KEY, "position", "n", *[F.col(f"l{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"p{k}") for k in (1, 2)])


def maximal(rolled: DataFrame) -> DataFrame:
    """``(conv, copies)`` of the conversations that no other one continues, equal ones joined in the least."""
    whole = rolled.where("position = n").groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    continued = rolled.where("position < n").select(F.col("position").alias("n"), "p1", "p2").distinct()
    return whole.join(continued, ["n", "p1", "p2"], "left_anti").select("conv", "copies")


def _apart(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, position, n_turns, copies, rendered)``: a row for each turn of the maximal conversations, with its place
    from 1 and the conversation's length."""
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    rolled = saved(prefixes(turns), "prefixes")
    kept = spread_join(rolled.select(*_KEY, "position", "n"), maximal(rolled), "conv", "position")
    # repeated rows are one before they are shuffled
    texts = turns.groupBy(*_KEY).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    shown = F.concat(F.lit(START), _apart(F.col("role")), F.lit("\n"), _apart(F.col("text")), F.lit(END + "\n"))
    return texts.join(kept, _KEY).select(F.col("conv.conv_id").alias("conv_id"), "position", F.col("n").alias("n_turns"), "copies", shown.alias("rendered"))


def conversations(rendered: DataFrame, max_turns: int = 10_000) -> DataFrame:
    """``(conv_id, n_turns, copies, rendered)``: what ``render`` gave, a row for each conversation. One of more than ``max_turns``
    turns would be a text without bound in one task, and is an error."""
    longer = F.raise_error(F.concat(F.lit(f"a conversation has more than {max_turns} turns: "), F.col("n_turns").cast("string")))
    turn = F.when(F.col("n_turns") <= max_turns, F.struct("position", "rendered")).otherwise(longer)
    joined = rendered.groupBy("conv_id", "n_turns", "copies").agg(F.collect_list(turn).alias("all"))
    return joined.select("conv_id", "n_turns", "copies", F.array_join(F.transform(F.sort_array("all"), lambda t: t["rendered"]), "").alias("rendered"))
