"""Chat formatting by prefix-target expansion (native).

Every assistant turn becomes one example: all preceding turns are its context
and only that reply is trainable. A conversation that ends in another role, or
has no assistant turn, gets one more example without a trainable part, so that
the formatted output always holds the whole conversation.

Template
    ``<s>[ROLE]role[/ROLE][INST]text[/INST]</s>`` for any role but assistant,
    ``<s>[ROLE]assistant[/ROLE]text</s>`` for assistant.
Control strings inside roles and texts are escaped: a backslash is doubled and
a backslash is put behind the first character of a control string. Removing the
backslash before any character restores the text exactly.

Defined cases
    null role or text: the empty string; null turn: sorts first; repeated turn
    numbers: ordered by role, then text; repeated rows: kept, both are turns;
    null conv_id: one conversation of its own; empty table: no rows; columns
    beyond conv_id, turn, role and text are ignored whatever their names.

Scale: one shuffle by conv_id. The last example of a conversation is the
conversation itself, so a conversation has to fit into a row in any case; the
examples are built row by row and never gathered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
INST, INST_END = "[INST]", "[/INST]"
TRAINED_ROLE = "assistant"
_CONTROL = r"(<(?=/?s>)|\[(?=/?(?:ROLE|INST)\]))"


def escape(text: Column) -> Column:
    """Text without any control string; reversed by :func:`unescape`."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rendered(turn: Column) -> Column:
    body = escape(turn["text"])
    return F.concat(
        F.lit(BEGIN + ROLE), escape(turn["role"]), F.lit(ROLE_END),
        F.when(turn["role"] == TRAINED_ROLE, body).otherwise(F.concat(F.lit(INST), body, F.lit(INST_END))),
        F.lit(END),
    )


def expand(conversations: DataFrame) -> DataFrame:
    """Rows by turn to examples.

    Returns conv_id, n_context (turns before the target), text, trainable,
    loss_start and loss_end (code points, 0-based, end exclusive; both at the
    end of the text where nothing is trainable) and complete (the example holds
    the whole conversation).
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TRAINED_ROLE).alias("trained"),
        F.transform("turns", _rendered).alias("parts"),
        F.size("turns").alias("n"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("trained", i) | (i == F.col("n")))
    rows = whole.select("conv_id", "trained", "parts", "n", F.explode(ends).alias("upto"))
    head = len(BEGIN + ROLE + TRAINED_ROLE + ROLE_END)
    trainable = F.element_at("trained", F.col("upto"))
    rows = rows.select(
        "conv_id",
        (F.col("upto") - 1).alias("n_context"),
        F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "").alias("text"),
        trainable.alias("trainable"),
        F.when(trainable, F.length(F.element_at("parts", F.col("upto"))) - (head + len(END))).otherwise(0).alias("_loss"),
        (F.col("upto") == F.col("n")).alias("complete"),
    )
    end = F.length("text") - F.when(F.col("trainable"), len(END)).otherwise(0)
    return rows.select(
        "conv_id", "n_context", "text", "trainable",
        (end - F.col("_loss")).alias("loss_start"), end.alias("loss_end"), "complete",
    )


def read_turns(text: Column) -> Column:
    """The (role, text) pairs of a formatted text."""
    parts = F.filter(F.split(text, F.lit(END), -1), lambda p: p != "")
    rest = lambda p: F.substring_index(p, ROLE_END, -1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(p, ROLE_END, 1), F.lit(BEGIN + ROLE), F.lit(""))).alias("role"),
            unescape(F.replace(F.replace(rest(p), F.lit(INST), F.lit("")), F.lit(INST_END), F.lit(""))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """What the formatted examples say, read back from them alone."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = examples.select(
        "conv_id",
        F.when(F.col("trainable"), F.struct(F.col("n_context"), loss.alias("loss"))).alias("l"),
        F.when(F.col("complete"), F.col("text")).alias("whole"),
        F.length("text").cast("long").alias("chars"),
    )
    by = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("l")).alias("l"),
        F.first("whole", ignorenulls=True).alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    by = by.select(
        "conv_id", read_turns(F.col("whole")).alias("turns"), "formatted_chars", "n_examples",
        F.array_join(F.transform("l", lambda x: x["loss"]), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
