"""Preference formatting: one prompt and two masked completions for each pair.

The longest common turn prefix of the chosen and the rejected conversation is
rendered once, as the prompt. What is left of each is rendered as a completion;
its mask lists the spans of code points to train on: what assistants say, with
the end mark. If one side has nothing left, its completion is empty.

Turns are gathered by pair, so one task holds the turns of two conversations,
which its output row has to hold anyway. Groups of equal conversations or first
turns need no comparing beyond their own pair.

Defined cases: turns are ordered by number, then role, then text, nulls first;
null roles and texts render as empty strings and equal only nulls; a side that
is missing has a null completion and mask, and the other's turns are then all
completion; rows of a null conversation id are left out; repeated turns stay;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
FIELDS = [
    T.StructField("prefix_turns", T.LongType(), False),
    T.StructField("prompt", T.StringType(), False),
    T.StructField("chosen", T.StringType()),
    T.StructField("rejected", T.StringType()),
    T.StructField("chosen_mask", _SPANS),
    T.StructField("rejected_mask", _SPANS),
]


def render(turns: list[tuple[str | None, str | None]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Text of the turns and the spans of those that ``trained`` says."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, tail = START + (role or "") + MIDDLE, (text or "") + END
        parts += (head, tail)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(tail)))
        at += len(head) + len(tail)
    return "".join(parts), spans


def pair_up(chosen: list | None, rejected: list | None) -> tuple:
    """The values of FIELDS for the turns (role, text) of two conversations."""
    n = 0
    for a, b in zip(chosen or (), rejected or ()):
        if a != b:
            break
        n += 1
    prompt, _ = render((chosen or [])[:n])
    sides = [render(x[n:]) if x is not None else (None, None) for x in (chosen, rejected)]
    return n, prompt, sides[0][0], sides[1][0], sides[0][1], sides[1][1]


def pairs_by_number(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Pairs of consecutive numbers: 2k is the chosen conversation, 2k + 1 the rejected one."""
    ids = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("id")).distinct()
    ids = ids.withColumn("pair_id", F.floor(F.col("id") / 2).cast("long"))
    return ids.groupBy("pair_id").agg(
        F.max(F.when(F.pmod("id", F.lit(2)) == 0, F.col("id"))).alias("chosen_id"),
        F.max(F.when(F.pmod("id", F.lit(2)) == 1, F.col("id"))).alias("rejected_id"),
    )


def format_preferences(
    conversations: DataFrame, pairs: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(pair_id, chosen_id, rejected_id) of ``pairs`` with the columns of FIELDS."""
    turns = conversations.select(
        F.col(conv_id).alias("id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t")
    )
    sides = pairs.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("id")))).alias("s"),
    ).select("pair_id", "chosen_id", "rejected_id", "s.side", "s.id")
    joined = sides.where("id is not null").join(turns, "id")
    grouped = joined.groupBy("pair_id", "chosen_id", "rejected_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(name) for k, name in ((0, "__c"), (1, "__r"))]
    )

    def make():
        def run(chosen, rejected):
            sides = [
                [[(t["role"], t["text"]) for t in x] if x else None for x in column.to_pylist()]
                for column in (chosen, rejected)
            ]
            rows = [pair_up(c, r) for c, r in zip(*sides)]
            masks = [[m and [{"start": a, "end": b} for a, b in m] for m in column] for column in ([r[4] for r in rows], [r[5] for r in rows])]
            return [[r[k] for r in rows] for k in range(4)] + masks

        return run

    return append_columns(grouped, ["__c", "__r"], FIELDS, make, ["pair_id", "chosen_id", "rejected_id"])
