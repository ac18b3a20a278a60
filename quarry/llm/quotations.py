"""Chat formatting by quotation linking.

A message's lines are split by quote level (the number of leading ``>``).  Runs of lines of one level
are passages; passages and their lines are normalised and hashed, and joined
to the paragraphs and lines that earlier messages of the same conversation wrote
themselves.  The message that a first-level passage comes from is the parent.  Messages are
then put in reply order (thread, then turn), without quotes and attribution lines.

The join is an as-of window over (conversation, hash): each quote takes the latest earlier
message with that hash, so a line that a conversation repeats thousands of times
makes no pairs.  Windows end with a span of SPAN turns, and what came before a span is one row in it, so no
conversation and no line gathers in one task.  Threads are found by pointer doubling in log(depth) rounds.

Defined cases: null or empty texts are messages without lines.  Repeated rows count once.  Messages
with equal conv_id and turn are told apart by role and text but share links.  Rows without
conv_id or turn are kept and not linked.  A quote whose source isn't found is dropped
from the text like others and leaves no parent.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Shorter passages and lines decide on a parent only where longer ones don't.
MIN_LINE = 8
SPAN = 1024


def _parts(messages: DataFrame) -> DataFrame:
    """message, conv_id, turn, at, level, line: the lines of each message; level 0 is its own text."""
    lines = messages.select("message", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    marks = F.regexp_extract("raw", r"^((?:[ \t]*>)+)", 1)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("line", F.regexp_replace("raw", r"^(?:[ \t]*>)+[ ]?", ""))
    order = Window.partitionBy("message").orderBy("at")  # the lines of one message
    following = F.lead("level").over(order)
    attribution = F.col("line").rlike(r"(?i)^\s*(on\b.*\bwrote|.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$") & (following > F.col("level"))
    return lines.withColumn("attribution", F.coalesce(attribution, F.lit(False)))


def _passages(lines: DataFrame) -> DataFrame:
    """message, conv_id, turn, level, passage (number), norm: runs of lines of one level, ended by blank lines."""
    order = Window.partitionBy("message").orderBy("at")
    blank = F.trim("line") == ""
    breaks = (F.col("level") != F.lag("level", 1, -1).over(order)) | F.lag(blank, 1, True).over(order)
    run = F.sum(breaks.cast("int")).over(order)
    kept = lines.withColumn("run", run).where(~blank & ~F.col("attribution"))
    norm = F.lower(F.trim(F.regexp_replace("line", r"\s+", " ")))
    kept = kept.withColumn("norm", norm)
    whole = kept.groupBy("message", "conv_id", "turn", "level", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]), " ").alias("norm"), F.count(F.lit(1)).alias("n"))
    single = kept.select("message", "conv_id", "turn", "level", "run", "norm", F.lit(0).alias("whole"))
    return whole.where("n > 1").select("message", "conv_id", "turn", "level", "run", "norm", F.lit(1).alias("whole")).unionByName(single)


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, thread_turn, depth, n_quotes, n_linked, body; (thread_turn, turn) is the reply order."""
    messages = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    messages = stored(messages.withColumn("message", F.monotonically_increasing_id()), "messages")  # the file fixes the numbers
    lines = stored(_parts(messages), "lines")
    passages = stored(_passages(lines).where("norm != ''").withColumn("hash", F.xxhash64("norm")).withColumn("size", F.length("norm")), "passages")
    placed = passages.where("conv_id is not null and turn is not null").withColumn("span", F.floor(F.col("turn") / SPAN))
    key = ["conv_id", "hash", "size", "span"]
    own = placed.where("level = 0").select(*key, "turn").distinct().withColumn("source", F.col("turn"))
    asked = placed.where("level > 0").select(*key, "turn", "message", "level", "run", "whole")
    spans = own.groupBy(*key).agg(F.max("source").alias("last")).unionByName(asked.select(*key).distinct(), allowMissingColumns=True).groupBy(*key).agg(F.max("last").alias("last"))
    ahead = F.max("last").over(Window.partitionBy("conv_id", "hash", "size").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    before = spans.withColumn("source", ahead).where("source is not null").select(*key, F.col("source").alias("turn"), "source")
    both = own.unionByName(before).unionByName(asked, allowMissingColumns=True)
    earlier = Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("origin", F.max("source").over(earlier)).where("message is not null")
    # a passage found whole stands before single lines, then the longest total, then the same of short ones, then the latest
    long = F.col("size") >= MIN_LINE
    votes = linked.where("origin is not null and level = 1").groupBy("message", "origin").agg(
        F.max(F.when(long, F.col("whole")).otherwise(0)).alias("long_whole"), F.sum(F.when(long, F.col("size")).otherwise(0)).alias("long_size"), F.max("whole").alias("whole"), F.sum("size").alias("size")
    )
    parents = votes.groupBy("message").agg(F.max(F.struct("long_whole", "long_size", "whole", "size", "origin")).alias("best")).select("message", F.col("best.origin").alias("parent_turn"))
    origins = linked.select("message", "run", "origin").unionByName(passages.where("level > 0 and (conv_id is null or turn is null)").select("message", "run"), allowMissingColumns=True)
    counts = origins.groupBy("message").agg(F.count_distinct("run").alias("n_quotes"), F.count_distinct(F.when(F.col("origin").isNotNull(), F.col("run"))).alias("n_linked"))
    bodies = lines.where("level = 0 and not attribution").groupBy("message").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))
    out = messages.drop("text").join(parents, "message", "left").join(counts, "message", "left").join(bodies, "message", "left")
    body = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\n{3,}", "\n\n"))
    out = stored(out.withColumn("body", F.regexp_replace(body, r"^\n+|\n+$", "")), "linked")

    hops = stored(out.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up")).withColumn("depth", F.lit(1).cast("long")), "hops")
    while True:  # pointers double until they stand on messages without parents
        above = hops.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = hops.join(above, ["conv_id", "up"], "left")
        if step.where("up2 is not null").isEmpty():
            break
        hops = stored(step.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "hops")
    out = out.join(hops, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("up", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body",
    )


def chat_records(conversations: DataFrame) -> DataFrame:
    """One row per thread: conv_id, thread_turn and messages (turn, role, body, parent_turn) in reply order.

    A thread is gathered in one row, so it suits conversations that fit one.
    """
    item = F.struct("turn", "role", "body", "parent_turn")
    return link_quotes(conversations).groupBy("conv_id", "thread_turn").agg(F.array_sort(F.collect_list(item)).alias("messages"))
