"""Chat formatting: fold an event log into messages, render them with a loss mask, and read back.

Native DataFrame code throughout. The log has one row per event::

    conv_id, turn, message, seq, kind, role, text

``kind`` is ``message``, ``edit`` or ``regenerate`` (the text starts anew from this event's text) or
``delta`` (the text goes on). Events of one (conv_id, turn, message) fold in the order of ``seq``,
ties by kind, role and text; an event that repeats with the same values counts once. Messages stand by turn,
then role, text and message; messages that repeat a turn are kept. Null text is empty, a null role
is empty, a null conv_id is a conversation of its own, further columns are ignored, and an empty log
gives no rows.

Grouping first by message and then by conversation keeps the fold of a very long conversation apart
over its messages; only its rendered text, which is one value of the result, comes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, END, HEAD, TAIL)
#: Ends a turn; the line break is outside the text.
STOP = END + "\n"


def escaped(text: Column) -> Column:
    """Doubles every backslash, then sets one backslash inside each control string."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    """Undoes escaped(): after doubling, a single backslash inside a control string is only ours."""
    for c in CONTROLS:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def fold_events(log: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, message, role, text."""
    events = F.array_distinct(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))))
    folded = log.groupBy("conv_id", "turn", "message").agg(events.alias("events"))
    anew = F.array_max(
        F.transform("events", lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i))
    )
    texts = F.transform(
        F.slice("events", F.coalesce(anew, F.lit(0)) + 1, F.size("events")),
        lambda e: F.coalesce(e["text"], F.lit("")),
    )
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return folded.select(
        "conv_id",
        "turn",
        "message",
        F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(texts, "").alias("text"),
    )


def render(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, formatted, mask.

    mask has a struct for each turn: ``before`` code points that are not learned, then ``on`` that
    are, then ``after``; the turns' lengths add up to the formatted text's.
    """
    turns = messages.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "message"))).alias("turns")
    )
    parts = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda m: F.struct(
                F.concat(F.lit(BEGIN + HEAD), escaped(m["role"]), F.lit(TAIL)).alias("head"),
                escaped(m["text"]).alias("body"),
                m["role"].isin(*learn_roles).alias("learn"),
            ),
        ).alias("parts"),
    )
    zero = F.lit(0)
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(STOP))), "").alias(
            "formatted"
        ),
        F.transform(
            "parts",
            lambda p: F.struct(
                (F.length(p["head"]) + F.when(p["learn"], zero).otherwise(F.length(p["body"]))).alias("before"),
                F.when(p["learn"], F.length(p["body"])).otherwise(zero).alias("on"),
                F.lit(len(STOP)).alias("after"),
            ),
        ).alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """From the formatted text and its mask alone: the turns (role, text) and the learned texts."""
    pieces = F.split("formatted", STOP)
    cut = rendered.select("*", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, TAIL, 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(BEGIN + HEAD) + 1))).alias("role"),
            unescaped(F.substr(piece, F.length(head) + len(TAIL) + 1)).alias("text"),
        )

    return cut.select(
        *rendered.columns,
        F.transform("pieces", turn).alias("turns"),
        F.zip_with(
            "pieces", "mask", lambda p, m: unescaped(F.substr(p, m["before"] + 1, m["on"]))
        ).alias("learned"),
    )


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
