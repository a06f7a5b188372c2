"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log of events per conversation is folded into final messages, and those are
rendered with a template that marks turns and escapes its own control strings
reversibly.

Events: conv_id, seq, kind, turn, role, text.
  message     a new message at ``turn`` (several at one turn stay apart, by seq)
  delta       appended to the newest message of its turn
  edit        replaces the text of the newest message of its turn
  regenerate  as edit, and deltas after it go on from its text
An edit or regeneration takes back every message of a later turn that is older than it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN_HEAD, HEAD_END, TURN_END = "### ", ":\n", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    r"""Backslash, ``###`` and ``</turn>`` get backslashes, so a text never holds a control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\#\\#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    """Every backslash stands for the character after it."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events into final messages: conv_id, messages array<struct<turn, seq, role, text>>.

    Null text is empty; null kind is a message; null turn and null seq sort
    last; rows equal in seq sort by kind, role and text. Deltas and edits before any message of their
    turn make one, with their own role. Null conv_id is a conversation of its own.
    Extra columns are ignored; an empty log gives an empty result.
    """
    ordered = events.select("conv_id", "turn", F.struct(F.col("seq").isNull().alias("last"), "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    # one exchange, by conversation: the finer grouping by turn is met by it
    turns = ordered.repartition("conv_id").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("e"))
    starts = F.filter(F.sequence(F.lit(0), F.size("e") - 1), lambda i: (i == 0) | (F.get(F.col("e"), i)["kind"] == "message"))
    turns = turns.withColumn("starts", starts)
    turns = turns.withColumn("messages", F.transform("starts", lambda at, k: _message(at, F.coalesce(F.get(F.col("starts"), k + 1), F.size("e")))))
    takes_back = F.array_max(F.transform(F.filter("e", lambda x: x["kind"].isin("edit", "regenerate")), lambda x: x["seq"]))
    turns = turns.withColumn("takes_back", takes_back)
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("dead", F.max("takes_back").over(earlier))
    alive = F.filter("messages", lambda m: F.col("dead").isNull() | m["updated"].isNull() | (m["updated"] > F.col("dead")))
    place = F.transform(alive, lambda m: F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), m["seq"].isNull().alias("late"), m["seq"].alias("seq"), m["role"].alias("role"), m["text"].alias("text")))
    conversations = turns.select("conv_id", place.alias("m")).groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    return conversations.select("conv_id", F.transform("m", lambda m: F.struct(m["turn"].alias("turn"), m["seq"].alias("seq"), m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def _message(at: Column, end: Column) -> Column:
    """The message made of events at..end-1: the text of the last event that sets one, and the deltas after it."""
    own = F.slice("e", at + 1, end - at)
    sets = F.array_max(F.transform(own, lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    text = F.array_join(F.transform(F.slice(own, sets + 1, F.size(own)), lambda x: x["text"]), "")
    return F.struct(F.get(own, F.lit(0))["seq"].alias("seq"), F.get(own, F.lit(0))["role"].alias("role"), text.alias("text"), F.array_max(F.transform(own, lambda x: x["seq"])).alias("updated"))


def render(conversations: DataFrame) -> DataFrame:
    """Add ``formatted``, the rendered conversation, and ``mask`` array<struct<loss, skip, length>>, one entry for each turn of it.

    The loss mask covers the escaped texts of assistant messages and nothing else: where ``loss`` is true, the ``length``
    characters after the first ``skip`` of that turn. A null role renders as an empty one. Columns of those names are replaced.
    """
    head = lambda m: F.concat(F.lit(TURN_HEAD), escape_role(F.coalesce(m["role"], F.lit(""))), F.lit(HEAD_END))
    body = lambda m: escape(F.coalesce(m["text"], F.lit("")))
    parts = F.transform("messages", lambda m: F.struct(head(m).alias("head"), body(m).alias("body"), F.coalesce(m["role"] == LOSS_ROLE, F.lit(False)).alias("loss")))
    out = conversations.withColumn("__parts", parts)
    mask = F.transform("__parts", lambda p: F.struct(p["loss"].alias("loss"), F.length(p["head"]).alias("skip"), F.length(p["body"]).alias("length")))
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    return out.withColumns({"formatted": text, "mask": mask}).drop("__parts")


def _turns_of(formatted: Column) -> Column:
    """The turns of a rendered conversation as they stand, without their end marks: a text never holds one."""
    pieces = F.split(formatted, TURN_END, -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, read from the string alone: array<struct<role, text>>."""
    head = r"(?s)^### ((?:[^\\:]|\\.)*+):\n"

    def one(piece: Column) -> Column:
        role = F.regexp_extract(piece, head, 1)
        body = F.substring(piece, F.length(role) + len(TURN_HEAD) + len(HEAD_END) + 1, F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(_turns_of(formatted), one)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text of a rendered conversation under the loss mask, cut from the string and unescaped, in order."""
    covered = F.filter(F.zip_with(_turns_of(formatted), mask, lambda t, m: F.when(m["loss"], F.substring(t, m["skip"] + 1, m["length"]))), lambda x: x.isNotNull())
    return F.array_join(F.transform(covered, unescape), "")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of message events."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, messages, formatted, mask for every conversation of a log."""
    return render(reconstruct(events))
