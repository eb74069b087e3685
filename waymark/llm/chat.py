"""Every participant of a conversation in turn as the assistant.

``rotate_perspectives`` renders each conversation once per participant: turns of that
speaker become assistant messages, turns of the others become named user messages and
system turns stay system messages. The mask is true where the loss counts: on the
assistant's messages.

A rendered dialogue is returned as its messages, one row each, with the code-point range the
message takes in the dialogue. Long conversations therefore never meet in one row or task:
offsets are prefix sums that split a conversation held by most rows.

Defined results: turns are ordered by number (null first), then role, then text. A null role
is the speaker ``unknown``, a null text is an empty message, a null conversation id is one
conversation. Repeated rows are messages of their own. A conversation without a speaker (only
system turns) gives no rows. Control marks inside a text are broken up, so a text cannot pose
as another speaker. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.common import prefix_scan

SYSTEM = "system"
UNKNOWN = "unknown"


def _message(header: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), header, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def speaker_name(role: Column) -> Column:
    """A name that can stand in a header."""
    return F.regexp_replace(F.coalesce(role, F.lit(UNKNOWN)), r"[^\p{L}\p{N}_-]", "_")


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """``(conv_id, speaker, position, turn, role, message, start, end, mask)`` per message.

    ``position`` counts the messages of the dialogue from 0; ``end`` is exclusive.
    """
    clean = turns.select(
        "conv_id", "turn", speaker_name(F.col("role")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    speakers = (clean.where(F.col("role") != SYSTEM)
                .select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct())
    own = F.col("role") == F.col("speaker")
    header = (F.when(own, F.lit("assistant")).when(F.col("role") == SYSTEM, F.lit(SYSTEM))
              .otherwise(F.concat(F.lit("user name="), F.col("role"))))
    rendered = (clean.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
                .withColumn("message", _message(header, F.col("text")))
                .withColumn("length", F.char_length("message").cast("long"))
                .withColumn("mask", own))
    scanned = prefix_scan(rendered, ["conv_id", "speaker"], ["turn", "role", "text"],
                          {"start": "length"}, "position", "messages")
    return scanned.select("conv_id", "speaker", "position", "turn", "role", "message", "start",
                          (F.col("start") + F.col("length")).alias("end"), "mask")
