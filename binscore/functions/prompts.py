"""Prompt construction as array<struct<role, content>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: prompt wording must equal the reference (typos kept) ----
ZERO_SHOT_SYSTEM = (
    "You are an AI binary performance bug classifier that identifies whether "
    "the provided code contains perforamnce bug or not."
    "Provide response only in following format: performance bug: <YES or NO>"
    "Do not include anything else in response."
)
ZERO_SHOT_QUESTION = "Does the following code snippet contains any performance bug?"
TWO_SHOT_SYSTEM = (
    "You are an AI binary classifier tasked with identifying whether a code file contains performance bugs. "
    "Respond only in the following format: performance bug: <YES or NO>. Do not include anything else in the response. "
)
TWO_SHOT_QUESTION = "Does the following code snippet contain any performance bug?\n"
ANSWER_YES = "performance bug: YES"
ANSWER_NO = "performance bug: NO"
# ---------------------------------------------------------------------------

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def zero_shot_prompt(content) -> Column:
    """System instruction + question with the file appended (no
    separator, as in the reference)."""
    return F.array(
        _msg("system", F.lit(ZERO_SHOT_SYSTEM)),
        _msg("user", F.concat(F.lit(ZERO_SHOT_QUESTION), _c(content))),
    )


def two_shot_prompt(content, positive, negative) -> Column:
    """System, positive example + YES, negative example + NO, target."""
    def ask(x):
        return F.concat(F.lit(TWO_SHOT_QUESTION), _c(x), F.lit("\n"))

    return F.array(
        _msg("system", F.lit(TWO_SHOT_SYSTEM)),
        _msg("user", ask(positive)),
        _msg("assistant", F.lit(ANSWER_YES)),
        _msg("user", ask(negative)),
        _msg("assistant", F.lit(ANSWER_NO)),
        _msg("user", ask(content)),
    )


def render_prompt(messages) -> Column:
    """Flatten a message list to ``role: content`` lines (for hashing,
    token counting and predictors that take plain text)."""
    return F.array_join(
        F.transform(_c(messages), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
