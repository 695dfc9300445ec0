"""Chat formatting: each dialogue once for each participant, who speaks there as the assistant.

A message of the participant is rendered under the header of the assistant and trained on; those
of others stand under the header of a named user, system messages under that of the system, and
both are masked. DataFrame functions only.

A rendered dialogue comes in pieces of BLOCK messages, whatever its size: its pieces in order,
joined, are the whole dialogue. The messages' places are counted in ranges of the sorted messages,
so that a dialogue with a third of all messages, or a turn with as many, is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import cut

#: Messages in a piece, and groups to which the pieces of one dialogue are dealt for the join with its speakers.
BLOCK, GROUPS = 64, 64
START, END, UNNAMED = "<|im_start|>", "<|im_end|>", "unknown"


def safe(text: Column) -> Column:
    """The text with its own marks parted, so that it can't end a message or begin one."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def placed(messages: DataFrame) -> DataFrame:
    """messages (key, turn, speaker, content distinct) with place: their number in the dialogue, from 0."""
    order = ["key", "turn", "speaker", "content"]
    ranges = cut(messages.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("key", "range").orderBy("turn", "speaker", "content")) - 1
    return ranges.withColumn("own", own).join(counts.select("key", "range", before.alias("before")), ["key", "range"]).withColumn("place", F.col("before") + F.col("own")).drop("own", "before", "range")


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, piece, n_messages, n_rows, text, mask, n_trained.

    mask: array of (start, end), the characters of the piece's text to train on: the contents and
    end marks of the perspective's messages. n_trained is their sum. piece p has the messages from
    BLOCK * p on.

    Messages stand in order of turn, nulls first, then speaker, then text. A null speaker is
    'unknown', a null text empty. Rows with equal conversation, turn, speaker and text are one
    message; n_rows counts them. Speakers in system get no perspective, so a dialogue of them alone
    gives no row. A null conv_id is a conversation. Other columns are left out; no rows give none.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null"))
    own = messages.select(key.alias("key"), F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit(UNNAMED)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    own = placed(own.groupBy("key", "conv_id", "turn", "speaker", "content").agg(F.count("*").alias("rows")))
    pieces = own.groupBy("key", "conv_id", F.floor(F.col("place") / BLOCK).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("place", "speaker", "content"))).alias("messages"), F.count("*").alias("n_messages"), F.sum("rows").alias("n_rows")
    )
    people = own.groupBy("key", F.col("speaker").alias("perspective")).agg(F.max("place").alias("last"))
    last = people.groupBy("key").agg(F.max("last").alias("last"))
    people = people.where(~F.col("perspective").isin(*system)).select("key", "perspective").join(last, "key")
    people = people.withColumn("group", F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("last") / BLOCK), F.lit(GROUPS - 1))))).drop("last")
    seen = pieces.withColumn("group", F.pmod("piece", F.lit(GROUPS))).join(people, ["key", "group"])

    head = lambda m: F.when(m["speaker"] == F.col("perspective"), F.lit(f"{START}assistant\n")).when(m["speaker"].isin(*system), F.concat(F.lit(START), m["speaker"], F.lit("\n"))).otherwise(F.concat(F.lit(f"{START}user name="), safe(F.regexp_replace(m["speaker"], r"\s", "_")), F.lit("\n")))
    parts = F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(safe(m["content"]), F.lit(END)).alias("body"), (m["speaker"] == F.col("perspective")).alias("own")))
    seen = seen.withColumn("parts", parts).drop("messages")
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + 1
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    step = lambda acc, p: F.struct((acc["at"] + size(p)).alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + size(p) - 1).alias("end"))))).otherwise(acc["mask"]).alias("mask"))
    return seen.select(
        "conv_id",
        "perspective",
        "piece",
        "n_messages",
        "n_rows",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("parts", begin, step, lambda acc: acc["mask"]).alias("mask"),
        F.aggregate("parts", F.lit(0), lambda acc, p: acc + F.when(p["own"], F.length(p["body"])).otherwise(0)).cast("long").alias("n_trained"),
    )
