"""Chat formatting by event-sourced reconstruction, on DataFrame functions only.

A log holds, per conversation and in sequence, events on messages: ``open`` begins one with its role, ``delta``
adds text, ``edit`` replaces what there is, ``regenerate`` throws it away. Folding a message means to keep what
follows its last edit or regeneration. Messages are folded first, each on its own, so that a long
conversation is only put together from finished messages; then it is rendered as one text with a loss mask.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Inside roles and texts a backslash is put
into every ``<|``, after the backslashes that are there already, which can be taken out again; a role's line
breaks become ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.shared import written

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
DELTA = 256  # characters of a streamed piece


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def event_log(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """(conv_id, seq, message, event, role, text): the log that a chat service would have kept for ``turns``
    (conv_id, turn, role, text).

    Messages stream in pieces of ``delta`` characters. Every fourth one, by digest, was something else first: an
    assistant's was regenerated, any other edited. Rows of equal turn follow each other by role and text, rows
    that agree in all are alike. Null texts and roles are empty, null turns come first; a null conversation is one.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    changed = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(4)) == 0
    regenerated = changed & (F.col("role") == "assistant")
    count = F.ceil(F.char_length("text") / F.lit(delta)).cast("int")

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("event"), text.alias("text"))

    empty = F.array().cast("array<struct<event:string,text:string>>")
    streamed = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: event("delta", F.substr("text", i * delta + 1, F.lit(delta))),
    )
    draft = F.array(event("delta", F.concat(F.lit("draft of "), F.col("role"))))
    events = F.concat(
        F.array(event("open", F.lit(""))),
        F.when(changed, draft).otherwise(empty),
        F.when(regenerated, F.array(event("regenerate", F.lit("")))).otherwise(empty),
        F.when(changed & ~regenerated, F.array(event("edit", F.col("text")))).otherwise(streamed),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("events", events).withColumn("message", F.row_number().over(order).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.size("events")).over(before), F.lit(0)))
    log = rows.select("conv_id", "message", "role", "begin", F.posexplode("events").alias("nth", "e"))
    return log.select("conv_id", (F.col("begin") + F.col("nth")).alias("seq"), "message", "e.event", "role", "e.text")


def fold_messages(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): each message as its events leave it; ``message`` is its place in the conversation.

    Events of a message are taken in sequence; its last edit or regeneration and what follows count. Messages are in
    order of their first event. Events of null text add nothing; a message's role is that of its events.
    """
    reset = F.max(F.when(F.col("event").isin("edit", "regenerate"), F.col("seq")))
    pieces = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    folded = log.groupBy("conv_id", "message").agg(
        F.min("seq").alias("first"), F.max("role").alias("role"), reset.alias("reset"), pieces.alias("pieces")
    )
    kept = F.filter("pieces", lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    text = F.array_join(F.transform(kept, lambda p: p["text"]), "")
    return folded.select("conv_id", F.col("first").alias("message"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): one text per conversation, and the places of the ``trained`` role's texts in it.

    ``mask`` is an array of (start, end), code points, end exclusive, in order. A conversation is one text, so
    its finished messages come together in one task.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK))
    text = escape(F.col("text"))
    lines = messages.select(
        "conv_id", "message", (F.col("role") == trained).alias("own"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"),
    )
    # A message's place: the characters of all messages before it.
    size = F.char_length("head") + F.char_length("body") + F.lit(len(END) + 1)
    lines = lines.withColumn("size", size.cast("long"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("own"), F.struct("start", (F.col("start") + F.char_length("body")).alias("end")))
    line = F.struct("message", F.concat("head", "body", F.lit(END + "\n")).alias("line"))
    whole = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sort_array(F.collect_list(span)).alias("mask"))
    return whole.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("formatted"), "mask")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text, masked): the messages of formatted texts, unescaped, and what of each the mask holds,
    null where it holds nothing."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2**31 - 1)
    each = rendered.select("conv_id", F.posexplode(segments).alias("nth", "segment"))
    order = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.char_length("segment") + F.lit(len(START))).over(order)
    role = F.substring_index("segment", "\n", 1)
    each = each.withColumns({"end": end, "raw": role})
    body = F.substr("segment", F.char_length("raw") + 2, F.char_length("segment") - F.char_length("raw") - len(END) - 2)
    each = each.withColumns({"body": body, "start": F.col("end") - F.char_length("segment") + F.char_length("raw") + 1})
    spans = rendered.select(F.col("conv_id").alias("of"), F.explode("mask").alias("m")).select("of", "m.start", "m.end")
    spans = spans.select("of", F.col("start").alias("from"), F.col("end").alias("upto"))
    joined = each.join(spans, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("from")), "left")
    masked = F.substr("body", F.lit(1), (F.col("upto") - F.col("from")).cast("int"))
    return joined.select(
        "conv_id", "nth", unescape(F.replace(F.col("raw"), F.lit(BREAK), F.lit("\n"))).alias("role"),
        unescape(F.col("body")).alias("text"), unescape(masked).alias("masked"),
    )


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted texts: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turn = F.struct("nth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line"), F.coalesce("masked", F.lit("")).alias("masked"))
    per = read_back(rendered).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = per.select(
        F.col("conv_id").alias("of"), "n_turns",
        F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("lines"),
        F.array_join(F.transform("turns", lambda t: t["masked"]), "").alias("loss"),
    )
    sizes = rendered.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"))
    return sizes.join(whole, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def formatted_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, from its event log, written as a service would keep it, to the digests of what was formatted."""
    log = written(event_log(turns), "chat-log")
    return digests(written(render(fold_messages(log)), "formatted"))
