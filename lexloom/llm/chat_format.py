"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only the
text of that reply is trainable. Turns that no reply follows (the end of a conversation after its last
assistant turn, or a conversation without one) are kept in one further example without a trainable
part, so that the output holds the whole conversation and can be read back.

A turn is written ``### <role>: <text></turn>`` and a newline. In texts and roles the backslash and the
control strings are replaced by escapes that begin with a backslash; no escaped text holds a control
string, and ``unescape`` restores the original.

Rows are ordered by turn, ties by role and text. A null text or role counts as empty, a null
conversation id is one conversation, repeated rows are repeated turns. An empty table gives no examples.
Output size follows from the method: a conversation of n turns is written about n/2 times over. Its turns meet in one
row, from which its examples are made one by one, so a row holds the turns and one example, never all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import let

OPEN, CLOSE, SEP = "### ", "</turn>\n", ": "
# What is replaced, in this order; restored in the opposite order.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replace(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _replace(text, pairs)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return _replace(text, [(new, old) for old, new in reversed(pairs)])


def examples(rows: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """``conv_id, example, n_context, formatted, loss_start, loss_chars`` (code points, start from 0).

    ``example`` counts from 0 within its conversation; ``loss_start`` is null where nothing is trainable.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        return F.transform(
            t,
            lambda x: F.struct(
                F.concat(F.lit(OPEN), escape(x["role"], ROLE_ESCAPES), F.lit(SEP)).alias("head"),
                escape(x["text"]).alias("body"),
                (x["role"] == reply_role).alias("reply"),
            ),
        )

    def targets(p: Column) -> Column:
        """Index of the last turn of every example, and whether that turn is trained on."""
        ends = F.transform(p, lambda x, i: F.struct(i.alias("end"), x["reply"].alias("reply")))
        return F.filter(ends, lambda e: e["reply"] | (e["end"] == F.size(p) - 1))

    split = gathered.select("conv_id", parts(F.col("turns")).alias("_p"))
    # The ends first: each becomes a row, and only then its context is written.
    ends = split.select("conv_id", "_p", F.posexplode(targets(F.col("_p"))).alias("example", "_e"))
    before = F.transform(F.slice("_p", F.lit(1), F.col("_e.end")), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))
    made = ends.select(
        "conv_id", "example", "_e", F.array_join(before, "").alias("_context"), F.get("_p", F.col("_e.end")).alias("_last")
    )
    return made.select(
        "conv_id",
        "example",
        F.col("_e.end").alias("n_context"),
        F.concat("_context", "_last.head", "_last.body", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("_e.reply"), F.length("_context") + F.length("_last.head")).alias("loss_start"),
        F.when(F.col("_e.reply"), F.length("_last.body")).otherwise(0).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``, unescaped."""
    closed = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        at = F.locate(SEP, t)
        role = F.substring(t, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(t, at + len(SEP), F.length(t))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(closed, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns, their digest, the trained text and its digest.

    ``formatted_chars`` is the length of all examples of the conversation together.
    """
    loss = F.when(
        F.col("loss_start").isNotNull(),
        unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars"))),
    )
    read = formatted.select(
        "conv_id",
        "example",
        "n_context",
        F.length("formatted").cast("bigint").alias("chars"),
        loss.alias("loss"),
        "formatted",
    )
    # The example with the longest context holds every turn; a maximum keeps one row at a time.
    whole = read.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.max(F.struct("n_context", "formatted"))["formatted"].alias("whole"),
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))
                ),
                lambda x: x["loss"],
            ),
            "",
        ).alias("loss"),
    )

    def turns(t: Column) -> Column:
        text = F.array_join(
            F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""
        )
        return F.struct(F.size(t).cast("bigint").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"))

    return whole.select(
        "conv_id",
        let(read_turns(F.col("whole")), turns).alias("t"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    ).select("conv_id", "t.*", "loss_chars", "loss_sha256", "formatted_chars")
