"""Multi-party chat formatting: every participant's view of a dialogue, with column functions only.

For each participant, that speaker's turns become the assistant's, all others' those of named users, and system
turns stay system turns. The mask lists the spans of the row's text (code points, ends exclusive) that carry loss:
the assistant's words and the marker that ends them.

A view is one row. Only dialogues of more than ``part_turns`` turns are stored as several rows, parts of that many
turns each by exact rank, whatever their turn numbers; ``start`` is where a part's text begins in the view, so that
parts in order, joined, are the view. Turns are ranked by a range sort over all dialogues, so no task holds more
than a part of a dialogue, however long.

Defined results: null roles are participants named "unknown"; null texts are empty; equal rows count once; turns are
ordered by number, nulls first, then by role and text; null dialogue ids form one
dialogue; a dialogue of system turns alone gives no rows; an empty table gives no rows; other columns, whatever
their names, are ignored. Markers within texts are broken up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written

SYSTEM = "system"
PART_TURNS = 4096
START, END = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _user(role: Column) -> Column:
    return F.concat(F.lit(START + "user name="), F.regexp_replace(_plain(role), r"\s", F.lit("_")), F.lit("\n"))


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == SYSTEM, START + "system\n").when(role == speaker, START + "assistant\n").otherwise(_user(role))


def _ranked(rows: DataFrame, part_turns: int) -> DataFrame:
    """``rows`` with the part of each turn: its rank in the dialogue over ``part_turns``.

    A range sort puts turns in order over all partitions; within a partition the position is the row's number, and
    before it come the dialogue's turns of earlier partitions.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("slice", F.shiftright("at", 33)), "turns")
    slices = placed.groupBy("conv_id", "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("conv_id").alias("of"), F.col("slice").alias("s"), "first", "before")
    out = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("s")))
    return out.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).select("conv_id", "rank", F.floor(F.col("rank") / part_turns).alias("part"), "role", "text")


def _starts(turns: DataFrame, keys: DataFrame) -> DataFrame:
    """For the views of several parts (``keys``: conv_id, part, assistant): where each part's text begins."""
    user, assistant = F.length(_head(F.col("role"), F.lit(None))), len(START) + len("assistant\n")
    by_role = turns.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(user).alias("heads"), F.sum(F.length("text")).alias("texts"))
    by_role = written(by_role, "part-lengths")
    whole = by_role.groupBy("conv_id", "part").agg(F.sum(F.col("heads") + F.col("texts") + F.col("n") * (len(END) + 1)).alias("whole"))
    own = by_role.filter(F.col("role") != SYSTEM).select("conv_id", "part", F.col("role").alias("assistant"), (F.col("n") * assistant - F.col("heads")).alias("more"))
    k, w, o = keys.alias("k"), whole.alias("w"), own.alias("o")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.part") == F.col(f"{b}.part"))
    sized = k.join(w, same("k", "w")).join(o, same("k", "o") & (F.col("k.assistant") == F.col("o.assistant")), "left")
    sized = sized.select("k.conv_id", "k.part", "k.assistant", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("size"))
    before = Window.partitionBy("conv_id", "assistant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("conv_id", "part", "assistant", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))


def views(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, assistant, part, start, n_turns, n_trained, text, mask for every dialogue and participant."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"), _plain(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    ).distinct()
    ranked = _ranked(rows, part_turns)
    speakers = ranked.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("assistant")).distinct()
    parts = ranked.select("conv_id", "part").distinct()
    keys = written(parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"), "view-keys")
    several = keys.filter("part > 0").select("conv_id").distinct().select(F.col("conv_id").alias("of"))
    long = keys.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    long_turns = ranked.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    starts = _starts(long_turns, long).filter("part > 0").select(F.col("conv_id").alias("of"), F.col("part").alias("p"), F.col("assistant").alias("who"), F.col("start").alias("begins"))

    gathered = ranked.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))  # at most part_turns
    gathered = gathered.select(F.col("conv_id").alias("c"), F.col("part").alias("q"), "turns")
    pairs = keys.join(gathered, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("q"))).drop("c", "q")
    speaker = F.col("assistant")
    shown = pairs.withColumn("said", F.transform("turns", lambda t: F.struct((t["role"] == speaker).alias("own"), _head(t["role"], speaker).alias("head"), t["text"].alias("text"))))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["text"]) + len(END)
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["own"], F.concat(state["mask"], own)).otherwise(state["mask"]).alias("mask"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    out = shown.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (speaker == F.col("who")), "left")
    return out.select(
        "conv_id", "assistant", "part", F.coalesce("begins", F.lit(0)).alias("start"), F.size("said").alias("n_turns"), F.size(F.filter("said", lambda t: t["own"])).alias("n_trained"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "").alias("text"),
        F.aggregate("said", empty, step, lambda s: s["mask"]).alias("mask"),
    )
