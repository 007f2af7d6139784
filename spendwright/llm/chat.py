"""Chat formatting with Spark expressions.

Turn structs are collected and sorted, adjacent turns of one role are merged
into a block, and blocks are concatenated:

    <s>[ROLE]user[/ROLE]first text[TURN]second text</s><s>[ROLE]assistant[/ROLE]...</s>

A control string inside a role or text gets one backslash after its first
character (``</s>`` becomes ``<\\/s>``, and ``<\\/s>`` becomes ``<\\\\/s>``), so no text
can close a turn, and reading back takes one backslash away again.

Turns of equal number are ordered by role and text; null turn numbers come
first. Null roles and texts count as empty; a null conversation id is a
conversation of its own; repeated rows are repeated turns; an empty table
gives no rows. Other columns are ignored.

Turns are first collected in runs of ``RUN`` turn numbers and the sorted runs
then joined, so a very long conversation is sorted by many tasks; only its one
result row is put together in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ROLE, END_ROLE, TURN = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]"
RUN = 256
_NAMES = r"(/?s>|/?ROLE\]|TURN\]|/?INST\])"


def escape(text: Column) -> Column:
    """Break every control string, reversibly."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _NAMES, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _NAMES, "$1$2$3")


def _blocks(turns: Column) -> Column:
    """Runs of adjacent turns of one role: structs of role and texts."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    return F.zip_with(
        starts, ends, lambda a, b: F.struct(turns[a]["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts"))
    )


def _segments(blocks: Column, trained: str) -> Column:
    """Pieces of the formatted text with their loss mask."""

    def piece(text: Column, in_loss: Column) -> Column:
        return F.struct(text.alias("text"), in_loss.alias("in_loss"))

    def block(b: Column) -> Column:
        head = piece(F.concat(F.lit(OPEN + ROLE), escape(b["role"]), F.lit(END_ROLE)), F.lit(False))
        texts = F.transform(
            b["texts"], lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(TURN)), F.lit(False)), piece(escape(t), b["role"] == trained))
        )
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(CLOSE), F.lit(False))))

    return F.filter(F.flatten(F.transform(blocks, block)), lambda s: s["text"] != "")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``segments``.

    ``turns`` has conv_id, turn, role and text. ``segments`` are the pieces of
    ``formatted`` in order, each with its loss mask ``in_loss``.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    run = F.floor(F.col("turn") / RUN).alias("run")
    runs = rows.groupBy("conv_id", run).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "turns"))).alias("runs"))
    merged = whole.select("conv_id", F.flatten(F.col("runs.turns")).alias("turns")).select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    pieces = merged.select("conv_id", _segments(F.col("blocks"), trained_role).alias("segments"))
    return pieces.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of structs of role and text."""
    blocks = F.filter(F.split(formatted, r"</s>", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring(b, len(OPEN + ROLE) + 1, F.length(b)), END_ROLE, 1))
        body = F.substring(b, F.instr(b, END_ROLE) + len(END_ROLE), F.length(b))
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["in_loss"]), lambda s: unescape(s["text"])), "")
