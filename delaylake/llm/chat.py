"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and all others as named users; the masks mark what the assistant has to produce, its own
words and the mark that ends its turn. Narrators
(role ``system``) are rendered as such for everyone and get no perspective, nor does a null role,
which is rendered as a user without a name.

Messages are dealt into parts of ``PART`` by their running place in the conversation, which comes from
a range sort, and a row is one part from one perspective, so that no row or task gathers a
conversation (or a turn number that very many messages share) of unbounded length; parts in order
make up the dialogue. Equal rows (conversation, turn, role, text) are one message. Messages go
by turn, then role and text, nulls first; a null text is empty. ``<|`` inside names and texts
becomes ``< |``, so that marks stay unambiguous. An empty table gives an empty result, further
columns are ignored. The path is DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.functions.tables import positions
from delaylake.llm._common import cut, private

PART, NARRATORS, CLOSE = 256, ("system",), "<|end|>\n"


def _plain(value: Column) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART, narrators=NARRATORS) -> DataFrame:
    """Rows (conv_id, perspective, part, n_messages, text, masks); masks are (start, end) code points, ends exclusive."""
    rows = private(turns, conv_id=F.col(conv_id), turn=F.col(turn).cast("long"), role=F.col(role).cast("string"), text=F.col(text).cast("string")).distinct()
    placed = positions(rows, ["conv_id"], ["turn", "role", "text"], "place")
    parts = placed.groupBy("conv_id", F.floor(F.col("place") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("messages"))
    speakers = rows.filter(F.col("role").isNotNull() & ~F.col("role").isin(*narrators)).select("conv_id", F.col("role").alias("perspective")).distinct()
    # both sides are written, so that a conversation of very many parts can be split in the join
    parts, speakers = cut(parts, "parts"), cut(speakers, "speakers")
    named = speakers.withColumnRenamed("conv_id", "_id")
    joined = parts.join(named, parts["conv_id"].eqNullSafe(named["_id"]))

    def head(m: Column) -> Column:
        return (
            F.when(m["role"].isin(*narrators), F.concat(F.lit("<|"), m["role"], F.lit("|>\n")))
            .when(m["role"] == F.col("perspective"), F.lit("<|assistant|>\n"))
            .when(m["role"].isNull(), F.lit("<|user|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), _plain(m["role"]), F.lit("|>\n")))
        )

    drawn = F.transform(
        "messages",
        lambda m: F.struct(head(m).alias("head"), F.concat(_plain(m["text"]), F.lit(CLOSE)).alias("body"), F.coalesce(m["role"] == F.col("perspective"), F.lit(False)).alias("own")),
    )
    joined = joined.withColumn("drawn", drawn)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, end: long>>").alias("masks"))

    def step(state: Column, m: Column) -> Column:
        first = state["at"] + F.length(m["head"])
        last = first + F.length(m["body"])
        own = F.concat(state["masks"], F.array(F.struct(first.alias("start"), last.alias("end"))))
        return F.struct(last.alias("at"), F.when(m["own"], own).otherwise(state["masks"]).alias("masks"))

    return joined.select(
        "conv_id",
        "perspective",
        "part",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("drawn", lambda m: F.concat(m["head"], m["body"])), "").alias("text"),
        F.aggregate("drawn", start, step)["masks"].alias("masks"),
    )
