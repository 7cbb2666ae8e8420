"""Operator 6: chat formatting after collapsing cumulative snapshots.

A chat that grows is often logged after every turn, each log a prefix of the next. Rolling hashes over the turns name
every prefix of every conversation; a conversation whose whole hash is another one's proper prefix goes (anti-join on
distinct hashes, so a first turn that many share costs no more than any), and of equal ones the least conv_id stays.
Only then are texts gathered and rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import need, written


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, n_turns, prefixes): hashes of the first turn, the first two, ..."""
    one = F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")), 256)
    # ties of turn and role go by text, as they are rendered
    each = turns.select("conv_id", F.struct("turn", "role", "text", one.alias("h")).alias("t"))
    listed = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(acc, t):
        last = F.sha2(F.concat(acc["last"], t["h"]), 256)
        return F.struct(last.alias("last"), F.concat(acc["all"], F.array(last)).alias("all"))

    return listed.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.aggregate("ts", start, step, lambda acc: acc["all"]).alias("prefixes"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no proper prefix of another and the first of their equals."""
    named = written(prefix_hashes(turns), "turn-prefixes")
    whole = named.groupBy(F.element_at("prefixes", -1).alias("h")).agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"))
    shorter = named.select(F.explode(F.slice("prefixes", F.lit(1), F.col("n_turns").cast("int") - 1)).alias("h")).distinct()
    return whole.join(shorter, "h", "left_anti").select("conv_id", "n_turns")


def render_chats(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, text.

    conversations: conv_id, turn, role, text; extra columns are ignored. Turns go by turn, then role, then text; rows
    repeated whole are turns of their own. Rows with a null conv_id or turn belong to no place and go; a null role or
    text is empty. One conversation's texts must fit a task. No rows give none.
    """
    need(conversations, "conv_id", "turn", "role", "text")
    turns = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = maximal(turns)
    line = F.struct("turn", "role", "text")
    texts = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(line)).alias("ts"))
    return texts.select("conv_id", "n_turns", F.array_join(F.transform("ts", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "").alias("text"))
