"""Operator 6: chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text under the loss
mask. A conversation that does not end with an assistant turn gives one more row without a target, so that no turn is lost.

A turn is written `<|role|>`, a line feed, its text, `<|end|>` and a line feed. In texts and roles a backslash and the
first character of every control string become a backslash with a letter, so no text can hold a control string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the template, and the strings escaped in texts, in the order in which they are replaced
OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
ESCAPES = [("\\", "\\b"), ("<|", "\\l|"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\sINST]"), ("[/INST]", "\\s/INST]")]
ROLE_ESCAPES = [*ESCAPES, ("|", "\\p"), ("\n", "\\n")]
UNESCAPES = [("\\l", "<"), ("\\s", "["), ("\\p", "|"), ("\\n", "\n"), ("\\b", "\\")]
TARGET = "assistant"


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escaped(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescaped(text: Column) -> Column:
    return _replaced(text, UNESCAPES)


def examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, example, formatted, loss_start, loss_chars), one row per example.

    example: place of its last turn, from 1; loss_start: first trainable character, from 1 in code points; loss_chars:
    how many, null without a target. Turns are ordered by number (null first), then by role and text as written; turns
    that repeat a number or a whole row all stay. Null role or text counts as empty; rows of null id form one conversation.
    """
    text = escaped(F.coalesce(F.col(text_col), F.lit("")))
    role = _replaced(F.coalesce(F.col(role_col), F.lit("")), ROLE_ESCAPES)
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(END)).alias("piece"), F.when(F.col(role_col) == TARGET, F.char_length(text)).alias("loss"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece", "loss"))).alias("turns"))
    at = whole.select("id", F.col("turns.piece").alias("pieces"), F.col("turns.loss").alias("losses"), F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("example"))
    at = at.withColumn("loss_chars", F.element_at("losses", F.col("example")))
    at = at.where(F.col("loss_chars").isNotNull() | (F.col("example") == F.size("losses")))
    out = at.withColumn("formatted", F.array_join(F.slice("pieces", F.lit(1), F.col("example")), ""))
    start = F.char_length("formatted") - len(END) - F.col("loss_chars") + 1
    return out.select(F.col("id").alias(id_col), "example", "formatted", start.alias("loss_start"), "loss_chars")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    written = F.split(formatted, r"\Q" + END + r"\E")
    pieces = F.slice(written, F.lit(1), F.size(written) - 1)
    pieces = F.transform(pieces, lambda x: F.substring(x, len(OPEN) + 1, 1 << 30))
    role = lambda x: F.substring_index(x, MIDDLE, 1)
    text = lambda x: F.substr(x, F.char_length(role(x)) + len(MIDDLE) + 1)
    return F.transform(pieces, lambda x: F.struct(unescaped(role(x)).alias("role"), unescaped(text(x)).alias("text")))


def digests(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = unescaped(F.expr("substring(formatted, loss_start, loss_chars)"))
    rows = made.select(id_col, "example", "formatted", F.when(F.col("loss_chars").isNotNull(), F.struct("example", loss.alias("text"))).alias("loss"))
    out = rows.groupBy(id_col).agg(F.max_by("formatted", "example").alias("last"), F.sort_array(F.collect_list("loss"))["text"].alias("losses"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
    out = out.withColumns({"read": read_turns(F.col("last")), "masked": F.array_join("losses", "")})
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(id_col, F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
