"""Quotation linking in conversations, with DataFrame functions only.

Each message's lines are parsed for nested quote markers (``>``, any number, blanks between). Runs of
lines of one level are passages; they and their paragraphs, lines and sentences, normalised and hashed, are
joined within the conversation to the messages that first wrote them as text of their own. A message replies
to the origin of its outermost linked passage. Following replies up gives each message its path from the
first message of its thread; sorted by path, a conversation stands in reply order, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

_MARKS = r"^(?:[ \t]*>)+"
_WROTE = r"(?i)^\s*(?:on|am|le|el)\b.{0,300}:\s*$"
#: Sentences end at . ! ? or an ellipsis, with closing quotes and brackets, before a blank or a line's end.
_SENTENCE = r"(?<=[.!?\u2026][\"'\u2019\u201d\u00bb)\]]{0,3})\s+"
#: A paragraph, line or sentence of fewer words links only where it is the whole passage.
LEAST_WORDS = 3


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(passage: Column) -> Column:
    """The passage as a whole, its paragraphs, its lines and the sentences of both, normalised, without empty and short ones."""
    parts = F.array_distinct(F.concat(F.split(passage, r"\n\s*\n"), F.split(passage, "\n")))
    parts = F.array_distinct(F.concat(parts, F.flatten(F.transform(parts, lambda u: F.split(u, _SENTENCE)))))
    parts = F.filter(F.transform(parts, _normal), lambda u: F.size(F.split(u, " ")) >= LEAST_WORDS)
    whole = F.filter(F.array(_normal(passage)), lambda u: u != "")
    return F.array_distinct(F.concat(whole, parts))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` with body (own text) and passages, an array of (level, text)."""
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), "\x01\x02\r", "  ")
    parsed = messages.withColumn("__lines", F.split(clean, "\n", -1))
    marks = lambda x: F.regexp_extract(x, _MARKS, 0)
    parsed = parsed.withColumn("__levels", F.transform("__lines", lambda x: F.length(marks(x)) - F.length(F.replace(marks(x), F.lit(">"), F.lit("")))))
    level = lambda i: F.get(F.col("__levels"), i)
    lead_in = lambda x, i: (level(i) == 0) & (F.coalesce(level(i + 1), F.lit(0)) > 0) & F.regexp_like(x, F.lit(_WROTE))
    own = F.transform("__lines", lambda x, i: F.when((level(i) == 0) & ~lead_in(x, i), x))
    body = F.trim(F.regexp_replace(F.array_join(own, "\n"), r"\A\s+|\s+\z", ""))
    bare = lambda x: F.trim(F.regexp_replace(x, _MARKS, ""))
    starts = lambda i: (i == 0) | (level(i) != level(i - 1))
    quoted = F.transform("__lines", lambda x, i: F.when(level(i) > 0, F.concat(F.when(starts(i), F.concat(F.lit("\x01"), level(i), F.lit("\x02"))).otherwise("\n"), bare(x))).otherwise(""))
    runs = F.filter(F.split(F.array_join(quoted, ""), "\x01"), lambda x: x != "")
    passages = F.transform(runs, lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("level"), F.substring_index(x, "\x02", -1).alias("text")))
    return parsed.withColumn("body", body).withColumn("passages", passages).drop("__lines", "__levels")


def link(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, body, n_passages, n_linked, max_level, reply_to, reply_path.

    ``reply_to`` is the turn of the message replied to (null: none found); ``reply_path`` holds the turns
    from the thread's first message to this one; ordering a conversation by it puts replies under what they
    answer. Links go to earlier turns of the same conversation only: of several messages with a passage, the
    earliest is its origin. Of a message's links the outermost level counts, then the longest unit, then the
    later origin.

    Null texts are empty; messages with a null conv_id or turn link to nothing and have a path of their turn
    alone. Rows of the same conv_id and turn count as one message for links and give a row each. Other
    columns are dropped; an empty table gives no rows.
    """
    # Written, so that lines are parsed once and not again for each of the three reads below.
    given = stored(parse(messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")).drop("text"), "parsed")
    hashed = lambda units: F.transform(units, lambda u: F.struct(F.md5(u).alias("h"), F.length(u).alias("size")))
    own = given.select("conv_id", "turn", F.explode(hashed(_units(F.col("body")))).alias("u"))
    quoted = given.where(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("run", "p"))
    quoted = quoted.select("conv_id", "turn", "run", "p.level", F.explode(hashed(_units(F.col("p.text")))).alias("u"))
    quoted = quoted.select("conv_id", "turn", "run", "level", "u.h", "u.size")
    asked = quoted.select("conv_id", "h").distinct()
    origin = own.select("conv_id", "turn", "u.h").join(asked, ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    found = quoted.join(origin, ["conv_id", "h"]).where("source < turn")
    best = found.groupBy("conv_id", "turn", "run").agg(F.max(F.struct(-F.col("level"), "size", "source")).alias("m"))
    replies = best.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.max("m").alias("m"))
    replies = stored(replies.select("conv_id", "turn", "n_linked", F.col("m.source").alias("reply_to")), "replies")
    paths = thread_paths(replies.select("conv_id", "turn", "reply_to"))
    linked = replies.join(paths, ["conv_id", "turn"])
    rows = given.select("conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_passages"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level"))
    out = rows.join(linked, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", "n_passages", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level", "reply_to", F.coalesce("reply_path", F.array("turn")).alias("reply_path"))


def thread_paths(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_path of each reply: pointers double each round, so rounds are log2 of the depth."""
    state = replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.array("turn").alias("path"))
    last = None
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        joined = state.join(above, ["conv_id", "up"], "left")
        joined = joined.select("conv_id", "turn", F.when(F.col("path2").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"), F.concat(F.coalesce("path2", F.array().cast("array<long>")), "path").alias("path"), F.col("path2").isNotNull().alias("moved"))
        joined = stored(joined, "paths")
        discard(last)
        last = joined
        state = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return state.select("conv_id", "turn", F.concat(F.array("up"), "path").alias("reply_path"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
