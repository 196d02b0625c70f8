"""Multi-party perspective rotation of chats, in built-in functions only.

A dialogue is rendered once for each participant: that speaker's turns are the
assistant's and are trained on, the others' are a named user's and are not.
System turns are context in every rendering.  The result is long: one row for
each conversation, perspective and turn, with the rendered message, its role and
the span of it that counts in the loss.  A rendering is those rows in order of
turn, so a conversation of any length is never gathered into one row or task.

Participants are a partial distinct; the join on the conversation is a merge
join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What a name in a head can't hold: white space, control characters, ends of markers.
UNFIT = r"[\x00-\x20]+|<\||\|>"


def rotate(turns: DataFrame, context: str = "system", unknown: str = "unknown") -> DataFrame:
    """conv_id, perspective, turn, role, name, message, trained, span_from, span_to.

    ``message`` is ``<|im_start|>role[ name]\\ntext<|im_end|>\\n``.  ``span_from`` and
    ``span_to`` are the code points of it that are trained on (the assistant's
    text and end mark), equal where nothing is.  Markers that stand in a text are
    text: rows, not parsing, tell messages apart; in the name of a rendered head,
    white space, control characters and marker ends become an underscore, so that
    a head is one line.  A null speaker is a participant
    named ``unknown``; a null text is empty; null conversations are one
    conversation; repeated turns repeat.  A conversation of system turns alone
    has no participant and no rows, and neither has an empty table.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(unknown)).alias("speaker"), F.coalesce("text", F.lit("")).alias("said"))
    who = said.where(F.col("speaker") != context).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(who.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == context, "system").otherwise("user")
    name = F.when(~own & (F.col("speaker") != context), F.col("speaker"))
    shown = F.regexp_replace(name, UNFIT, "_")
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" "), shown), F.lit("")), F.lit("\n"))
    at = F.length(head)
    return each.select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("role"),
        name.alias("name"),
        F.concat(head, "said", F.lit(END + "\n")).alias("message"),
        own.alias("trained"),
        at.cast("long").alias("span_from"),
        (at + F.when(own, F.length("said") + len(END)).otherwise(0)).cast("long").alias("span_to"),
    )
