"""Chat formatting by multi-party perspective rotation (operator 3), with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with
that speaker as ``assistant``, every other speaker as a named ``user`` and
system turns as ``system``.  The loss mask covers what the assistant says and
its end mark: character spans in the rendered text.

A rendered dialogue is a sequence of chunks, each the turns of one range of
``CHUNK`` turn numbers, so no conversation is gathered into one row or task.
A range with more than ``SLICE`` turns (many speakers at one turn number) is
cut further, in dialogue order, into parts of at most ``SLICE`` turns: its turns
are sorted by ranges and numbered in that order.  ``dialogues`` puts the
rendered parts of a chunk together again, so cutting does not show in its rows.

Order within a chunk: turn (nulls last), speaker, text.  Equal rows are one
turn.  Rows without a conversation are ignored.  A turn without a speaker is
the user ``unknown``, who gets no perspective; a conversation of system turns
alone has none either.  A null text is empty.  ``<|`` in a text or name is
written ``< |``, so nothing a speaker says reads as a mark.  Other columns are
ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.scratch import written

CHUNK = 64
SLICE = 4096
#: Fixed marks of the rendered format.
BEGIN, END, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"


def _defused(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _turns(conversations: DataFrame, conversation: str, turn: str, speaker: str, text: str,
           system: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The different turns with chunk and part, those of crowded ranges (None without any) apart, and the participants."""
    turns = conversations.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(speaker).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv_id is not null").distinct()
    turns = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    people = turns.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system)).select(
        "conv_id", F.col("speaker").alias("perspective")).distinct()
    large = written(turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > SLICE)
                    .select(F.col("conv_id").alias("c"), F.col("chunk").alias("k")), "crowded")
    plain = F.lit(0).cast("long").alias("part")
    if large.isEmpty():
        return turns.select("*", plain), None, people
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k"))
    order = ["conv_id", "chunk", F.col("turn"), "speaker", "text"]  # a chunk's turns have all a number or none
    crowded = turns.join(large, same, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    # these ids rise along the ranges, without gaps within one
    crowded = written(crowded.withColumn("part", F.floor(F.monotonically_increasing_id() / SLICE) + 1), "parts")
    return turns.join(large, same, "left_anti").select("*", plain), crowded, people


def perspectives(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role",
                 text: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row for each conversation, participant, chunk and part.

    Columns: conv_id, perspective, chunk (turn range number; null for turns without a
    number), part (0 unless the range was cut; rising, not always by one, in dialogue
    order), n_turns, rendered and mask, an array of (start, end) in characters of rendered.
    """
    turns, crowded, people = _turns(conversations, conversation, turn, speaker, text, system)
    return _rendered(turns if crowded is None else turns.unionByName(crowded), people, system)


def dialogues(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role",
              text: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """``perspectives`` with one row for each conversation, participant and chunk, however crowded, and without ``part``."""
    turns, crowded, people = _turns(conversations, conversation, turn, speaker, text, system)
    whole = _rendered(turns, people, system).drop("part")
    if crowded is None:
        return whole
    parts = _rendered(crowded, people, system).groupBy("conv_id", "perspective", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("part", "n_turns", "rendered", "mask"))).alias("ps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, p):
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + F.length(p["rendered"])).alias("at"), F.concat(acc["out"], moved).alias("out"))

    return whole.unionByName(parts.select(
        "conv_id", "perspective", "chunk", F.aggregate("ps", F.lit(0).cast("long"), lambda n, p: n + p["n_turns"]).alias("n_turns"),
        F.array_join(F.col("ps.rendered"), "").alias("rendered"), F.aggregate("ps", start, step, lambda acc: acc["out"]).alias("mask")))


def _rendered(turns: DataFrame, people: DataFrame, system: tuple[str, ...]) -> DataFrame:
    said = F.col("speaker") == F.col("perspective")
    head = (F.when(said, F.lit("assistant")).when(F.col("speaker").isin(*system), F.lit("system"))
            .otherwise(F.concat(F.lit("user name="), _defused(F.coalesce("speaker", F.lit("unknown"))))))
    seen = turns.join(people, "conv_id").select(
        "conv_id", "perspective", "chunk", "part",
        F.struct(F.col("turn").isNull().alias("late"), "turn", "speaker", "text",
                 F.concat(F.lit(BEGIN), head, F.lit(NEWLINE)).alias("head"),
                 F.concat(_defused(F.col("text")), F.lit(END)).alias("body"),
                 F.coalesce(said, F.lit(False)).alias("said")).alias("t"))
    chunks = seen.groupBy("conv_id", "perspective", "chunk", "part").agg(
        F.array_sort(F.collect_list("t")).alias("ts"))  # at most SLICE turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["said"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return chunks.select(
        "conv_id", "perspective", "chunk", "part", F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(NEWLINE))), "").alias("rendered"),
        F.aggregate("ts", start, step, lambda acc: acc["out"]).alias("mask"))
