"""Preference formatting of chat: one prompt, two completions.

A pair of conversations shares its longest common prefix of turns. The prefix is rendered once, as
the prompt; what follows in each conversation is its completion, with the spans that a loss may
cover: the texts of assistant turns with their closing mark. Everything is one row's expression,
so pairs are formatted where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regressa.llm.common import keep, quoted, split_join

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
#: Places in which a conversation that is chosen very often meets its pairs.
SALTS = 64


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: role and text of each conversation's turns, in order.

    A row that repeats whole counts once; turns with one number are ordered by role and text;
    null numbers come first, null roles and texts are empty; null ids are one conversation.
    """
    turn = F.struct(F.col(quoted(turn_col)).alias("turn"),
                    F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("role"),
                    F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return rows.groupBy(F.col(quoted(id_col)).alias("conv_id")).agg(
        F.array_sort(F.collect_set(turn)).alias("t")) \
        .select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"),
                                                              x.text.alias("text"))).alias("turns"))


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """``(conv_id, rank, depth, node)``: a row for each prefix of a conversation that holds its
    request, ``node`` standing for its turns and ``depth`` for their number.

    The request ends with the first user turn; without one, with the first turn that is not the
    system's, or the last turn. A node is two running sums of hashes of the turns with their places,
    so a conversation of any length takes time in proportion to its turns.
    """
    user, other = (F.array_position(F.transform("turns", f), True) for f in (
        lambda x: x.role == USER, lambda x: x.role != SYSTEM))
    request = F.when(user > 0, user).when(other > 0, other).otherwise(F.size("turns")).cast("int")
    rank = F.struct((-F.size("turns")).alias("n"), F.col("conv_id").isNull().alias("unnamed"),
                    F.col("conv_id"))
    turns = convs.select("conv_id", rank.alias("rank"), request.alias("request"),
                         F.posexplode("turns").alias("i", "turn"))
    so_far = Window.partitionBy("conv_id").orderBy("i")
    marks = [F.sum(F.xxhash64(F.lit(seed), "i", "turn.role", F.length("turn.role"), "turn.text")
                   .cast("decimal(20,0)")).over(so_far).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    return turns.select("conv_id", "rank", "request", (F.col("i") + 1).alias("depth"), *marks) \
        .where(F.col("depth") >= F.col("request")) \
        .select("conv_id", "rank", "depth", F.struct("depth", "a", "b").alias("node"))


def preference_pairs(convs: DataFrame) -> DataFrame:
    """One pair for each conversation: ``(conv_id, chosen_id, kind, chosen, rejected)``.

    Conversations with one request (see ``prefix_nodes``) are a tree of shared prefixes. In each
    node, the one with most turns, then the smallest id, is chosen over each other one (kind
    ``sibling``): a star, and a conversation is in that of the deepest node where another one is
    chosen, so that it meets a sibling of its longest shared prefix, or is chosen over it. The
    conversation chosen for the request itself is paired with a copy whose last assistant turn
    repeats the assistant turn before it, or is empty if there is none (kind ``stale``); without
    an assistant turn the copy is equal.
    """
    nodes = keep(prefix_nodes(convs))
    # Only ids meet in the nodes; the turns of the chosen ones follow by id.
    best = nodes.groupBy("node").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") > 1).select("node", F.col("best.conv_id").alias("best"), "n")
    links = keep(split_join(nodes, keep(best), "node", nodes.count())
                 .where(~F.col("best").eqNullSafe(F.col("conv_id"))).groupBy(F.col("conv_id").alias("linked"))
                 .agg(F.max(F.struct("depth", "best")).alias("link")))
    counts = links.groupBy(F.col("link.best").alias("rep")).agg(F.count(F.lit(1)).alias("n"))
    # A conversation chosen over at least a thousandth of all (a thousand such, at most) stands
    # ready in ``SALTS`` places, which its pairs share.
    much = F.col("n") >= max(2, links.count() // 1000)
    hot = F.broadcast(counts.where(much).select(F.col("rep").alias("h"), F.lit(True).alias("hot")))
    reps = counts.select("rep", F.explode(F.sequence(F.lit(0), F.when(much, SALTS - 1).otherwise(0)))
                         .alias("salt"))
    reps = reps.join(convs.select(F.col("conv_id").alias("r"), F.col("turns").alias("rep_turns")),
                     F.col("rep").eqNullSafe(F.col("r"))).select("rep", "salt", "rep_turns")
    # Chosen conversations keep their own id as key, so that they do not meet in one.
    paired = convs.join(links, F.col("conv_id").eqNullSafe(F.col("linked")), "left").select(
        "conv_id", "turns", F.col("link").isNull().alias("own"),
        F.when(F.col("link").isNull(), F.col("conv_id")).otherwise(F.col("link.best")).alias("chosen_id"))
    paired = paired.join(hot, F.col("chosen_id").eqNullSafe(F.col("h")), "left").withColumn(
        "place", F.when(F.col("hot") & ~F.col("own"), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
        .otherwise(0).cast("int"))
    paired = paired.join(reps, F.col("chosen_id").eqNullSafe(F.col("rep")) & (
        F.col("place") == F.col("salt")), "left").withColumn(
        "chosen", F.when(F.col("own"), F.col("turns")).otherwise(F.col("rep_turns")))
    own = F.col("own")
    # Positions of assistant turns; the last one takes the text of the one before.
    spoken = F.filter(F.sequence(F.lit(1), F.size("turns")),
                      lambda i: F.element_at("turns", i).role == ASSISTANT)
    paired = paired.withColumn("spoken", spoken)
    said = F.when(F.size("spoken") > 1, F.element_at(
        "turns", F.element_at("spoken", F.greatest(F.lit(1), F.size("spoken") - 1))).text).otherwise("")
    paired = paired.withColumn("said", said).withColumn("at", F.try_element_at("spoken", F.lit(-1)))
    stale = F.transform("turns", lambda x, i: F.when(
        i + 1 == F.coalesce("at", F.lit(0)), F.struct(x.role.alias("role"), F.col("said").alias("text")))
        .otherwise(x))
    return paired.select("conv_id", "chosen_id", F.when(own, "stale").otherwise("sibling").alias("kind"),
                         "chosen", F.when(own, stale).otherwise(F.col("turns")).alias("rejected"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(
        F.lit(OPEN), x.role, F.lit("\n"), x.text, F.lit(CLOSE + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """``[start, end)`` in characters of the rendered turns, for each assistant turn."""
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc["at"] + F.length(x.role) + (len(OPEN) + 1)
        ends = opens + F.length(x.text) + len(CLOSE)
        span = F.struct(opens.cast("int").alias("start"), ends.cast("int").alias("end"))
        return F.struct((ends + 1).cast("int").alias("at"), F.when(
            x.role == ASSISTANT, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen",
                       rejected_col: str = "rejected") -> DataFrame:
    """``pairs`` (arrays of (role, text) turns) with, instead of both conversations: common_turns,
    prompt, chosen, rejected, chosen_loss, rejected_loss, usable.

    Input columns of these names are replaced. ``usable``: both completions hold a loss span and differ. A conversation that is a prefix of
    the other has an empty completion. Null conversations count as empty.
    """
    made = ["common_turns", "prompt", "chosen", "rejected", "chosen_loss", "rejected_loss", "usable"]
    a, b = (F.coalesce(F.col(quoted(c)), F.array().cast("array<struct<role:string,text:string>>"))
            for c in (chosen_col, rejected_col))
    others = [c for c in pairs.columns if c not in (chosen_col, rejected_col, *made)]
    pairs = pairs.select(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)],
                                  F.lit(0).alias("z")).alias("other"), a.alias("a"), b.alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    pairs = pairs.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("int"))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("n") + 1, F.greatest(F.lit(0), F.size(name) - F.col("n")))

    out = pairs.select(
        *[F.col(f"other.c{i}").alias(c) for i, c in enumerate(others)], F.col("n").alias("common_turns"),
        rendered(F.slice("a", 1, F.col("n"))).alias("prompt"),
        rendered(rest("a")).alias("chosen"), rendered(rest("b")).alias("rejected"),
        loss_spans(rest("a")).alias("chosen_loss"), loss_spans(rest("b")).alias("rejected_loss"))
    return out.withColumn("usable", (F.size("chosen_loss") > 0) & (F.size("rejected_loss") > 0)
                          & (F.col("chosen") != F.col("rejected")))
