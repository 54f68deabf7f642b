"""Chat formatting: every participant of a dialogue in turn as the assistant, the others as named users.

DataFrame functions only. The messages of a dialogue are ranked without gathering them, and rendered in parts of ``BLOCK`` messages.
A part knows where it starts in the whole rendering, and masks count from the start of the whole: parts put together in order
are the dialogue, whatever its length, and no row or task holds a whole one of unbounded length. Where a part starts follows
from sums over parts: a speaker's own messages have another head than in the eyes of others, by a fixed number of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import ranked
from ._base import Table

#: Messages in a rendered part.
BLOCK = 256
SYSTEM = "system"
NOBODY = "unknown"
END = "<|end|>"
ASSISTANT = "<|assistant|>\n"


def _others(name: Column, shown: Column) -> Column:
    """The head of a message in the eyes of anyone but its speaker."""
    return F.when(name == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), shown, F.lit("|>\n")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def perspectives(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, speaker, block, start, n_messages, rendered, mask): the dialogue as each participant sees it, in parts.

    ``rendered`` of parts 0, 1, ... one after the other is the whole dialogue, ``start`` where a part begins in it. ``mask`` lists
    the spans [start, stop) of the whole, in code points, that the speaker is to learn: the bodies of own messages with their end
    marks. Messages stand in the order of turn, name and text; exact repeats of a message (same conversation, turn, role and
    text) count once. System messages keep their role and are nobody's perspective: a conversation with no other message gives
    no row. A null role is the participant ``unknown``, a null text is empty, a null turn precedes all others, and null is a
    conversation of its own. Nothing within a text or a name can pass for a mark: ``<|`` of a text is written ``< |``, and ``<``,
    ``>``, ``|`` and line breaks of a shown name are ``(``, ``)``, ``/`` and blanks. Other columns are ignored, texts may be of any
    length, an empty table gives an empty one.
    """
    plain = conversations.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit(NOBODY)).alias("name"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).distinct()
    places = ranked(plain, ["turn", "name", "text"], ["conv_id"]).withColumn("block", F.expr(f"(rank - 1) div {block}"))
    table = Table(places.withColumn("head", _others(F.col("name"), F.translate("name", "<>|\r\n", "()/  "))).drop("turn"), "messages")
    messages = table.df
    size = F.length("head") + F.length("text") + F.lit(len(END) + 1)
    # few numbers for each part: windows over them, not over texts
    parts = messages.groupBy("conv_id", "block").agg(F.sum(size).alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("size").over(before.partitionBy("conv_id")), F.lit(0)))
    own = messages.where(F.col("name") != SYSTEM).groupBy(F.col("conv_id").alias("of"), F.col("name").alias("speaker"), F.col("block").alias("at"), F.col("head").alias("seen")).agg(F.count("*").alias("own"))
    people = own.select("of", "speaker", "seen").distinct()
    held = own.select(F.col("of").alias("c"), F.col("speaker").alias("s"), "at", "own")
    pairs = parts.join(people, _same(F.col("conv_id"), F.col("of")))
    pairs = pairs.join(held, _same(F.col("conv_id"), F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("at")), "left")
    spoken = F.coalesce(F.sum("own").over(before.partitionBy("conv_id", "speaker")), F.lit(0))
    pairs = pairs.select(F.col("conv_id").alias("c"), F.col("block").alias("at"), "speaker", (F.col("base") + spoken * (F.lit(len(ASSISTANT)) - F.length("seen"))).alias("start"))
    texts = messages.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "head", "text"))).alias("messages"))
    both = texts.join(pairs, _same(F.col("conv_id"), F.col("c")) & (F.col("block") == F.col("at")))
    mine = lambda m: m["name"] == F.col("speaker")
    rendered = F.transform("messages", lambda m: F.struct(F.when(mine(m), F.lit(ASSISTANT)).otherwise(m["head"]).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), mine(m).alias("own")))
    spans = F.aggregate(
        "parts",
        F.struct(F.col("start").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
            F.when(p["own"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return both.withColumn("parts", rendered).select(
        "conv_id",
        "speaker",
        "block",
        "start",
        F.size("parts").cast("long").alias("n_messages"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        spans.alias("mask"),
    )


def op1(conversations: DataFrame) -> DataFrame:
    """:func:`perspectives` with the mask as text, start:stop joined by commas."""
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return perspectives(conversations).withColumn("mask", spans)


SQL = """
WITH m AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, name AS speaker FROM m WHERE name <> 'system'
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, name, text) AS rank FROM m
), s AS (
  SELECT r.*, speaker, (rank - 1) // 256 AS block, text || '<|end|>' AS body,
    CASE WHEN name = 'system' THEN '<|system|>' || chr(10) WHEN name = speaker THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || translate(name, '<>|' || chr(13) || chr(10), '()/  ') || '|>' || chr(10) END AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM s
)
SELECT conv_id, speaker, block, min(first) AS start, count(*) AS n_messages, string_agg(head || body || chr(10), '' ORDER BY rank) AS rendered,
  coalesce(string_agg((first + length(head)) || ':' || (first + length(head) + length(body)), ',' ORDER BY rank) FILTER (WHERE name = speaker), '') AS mask
FROM o GROUP BY conv_id, speaker, block
"""
