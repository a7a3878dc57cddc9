"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``### role: text</turn>\\n``. Inside roles and texts, control
strings are replaced by codes of a backslash and a letter (and a backslash by
its own), so no text can hold a control string and the codes read back to
exactly what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
HEAD, COLON = "### ", ": "
#: Code by control string; the backslash comes first, and last when reading.
CODES = {"\\": "\\b", "</turn>": "\\t", "###": "\\h"}
ROLE_CODES = CODES | {":": "\\c"}


def _escape(text: Column, codes: dict[str, str]) -> Column:
    for plain, code in codes.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescape(text: Column, codes: dict[str, str]) -> Column:
    for plain, code in reversed(codes.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), _escape(turn["role"], ROLE_CODES), F.lit(COLON))


def conversations_as_turns(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: its turns in order (ties by role, then text)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def expand(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 0), n_examples, formatted, loss_start, loss_end.

    Each turn of the trained role gives one example: all turns before it as
    context, and that turn, whose text alone lies in the mask loss_start to
    loss_end (code points of ``formatted``, end exclusive). If turns follow the
    last such turn, or there is none, one more example holds all turns with an
    empty mask, so that the last example always holds the whole conversation.

    Null roles and texts count as empty, a null conv_id is a conversation like
    any other, repeated rows are repeated turns, and turns are ordered by turn
    (nulls first), role and text. An empty table gives no rows. The examples of
    one conversation together grow with the square of its turns, as the method
    has it; each is a row of its own.
    """
    convs = conversations_as_turns(conversations)
    rendered = F.transform("turns", lambda t: F.concat(_head(t), _escape(t["text"], CODES), F.lit(END)))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get(F.col("turns"), i - 1)["role"] == trained_role)
    masked = F.col("is_target")
    rows = (
        convs.select("conv_id", "turns", rendered.alias("rendered"), ends.alias("ends"))
        .withColumn("examples", F.when(F.array_contains("ends", F.size("turns")), F.col("ends")).otherwise(F.concat("ends", F.array(F.size("turns")))))
        .select("conv_id", "turns", "rendered", F.size("ends").alias("n_targets"), F.size("examples").alias("n_examples"), F.posexplode("examples").alias("example", "upto"))
        .select(
            "conv_id", "example", "n_examples", (F.col("example") < F.col("n_targets")).alias("is_target"),
            F.get("turns", F.col("upto") - 1).alias("target"),
            F.array_join(F.slice("rendered", F.lit(1), F.col("upto") - 1), "").alias("context"),
            F.get("rendered", F.col("upto") - 1).alias("last"),
        )
    )
    start = F.length("context") + F.length(_head(F.col("target")))
    formatted = F.concat("context", "last")
    return rows.select(
        "conv_id", "example", "n_examples", formatted.alias("formatted"),
        F.when(masked, start).otherwise(F.length(formatted)).alias("loss_start"),
        F.when(masked, F.length(formatted) - len(END)).otherwise(F.length(formatted)).alias("loss_end"),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The plain text under an example's mask."""
    return _unescape(F.substring(formatted, start + 1, end - start), CODES)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, END, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(part: Column) -> Column:
        colon = F.locate(COLON, part)
        return F.struct(
            _unescape(F.substring(part, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1), ROLE_CODES).alias("role"),
            _unescape(F.substring(part, colon + len(COLON), F.length(part)), CODES).alias("text"),
        )

    return F.transform(turns, one)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from them, per conversation."""
    turns = read_turns(F.col("formatted"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    last = F.col("example") == F.col("n_examples") - 1
    rows = examples.select(
        "conv_id",
        F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).alias("part"),
        F.length("formatted").alias("chars"),
        F.when(last, F.size(turns)).alias("n_turns"),
        F.when(last, F.sha2(whole.cast("binary"), 256)).alias("turns_sha256"),
    )
    sums = rows.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return sums.select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
