"""Role-tagged messages and the templates that make them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "struct<role: string, content: string>"
HISTORY = f"array<{MESSAGE}>"

# The roles, and the request that makes an assistant speak first.
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
PASS_THROUGH = "{message}"
PROACTIVE_TRIGGER = (
    "Generate 5 questions to the user that will help you get all the information "
    "that is relevant for you to fulfill your task."
)


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.cast("string").alias("content"))


def fill(template: str, params: dict[str, Column] | None = None) -> Column:
    """Text of a template with every ``{name}`` replaced by the column given for it."""
    params = params or {}
    pieces = re.split(r"\{(\w+)\}", template)
    missing = sorted(set(pieces[1::2]) - set(params))
    if missing:
        raise ValueError(f"no value for {missing}")
    parts = [
        params[p].cast("string") if place % 2 else F.lit(p)
        for place, p in enumerate(pieces)
        if place % 2 or p
    ]
    return F.concat(*parts) if parts else F.lit("")


def fill_template(template: str, role: str, params: dict[str, Column] | None = None) -> Column:
    """The filled template as a message of the role."""
    return message(role, fill(template, params))


def no_history() -> Column:
    return F.array().cast(HISTORY)


def last_content(history: Column) -> Column:
    """Text of the last message, null if there is none."""
    return F.get(history, F.size(history) - 1)["content"]


def parse_steps(reply: Column) -> Column:
    """A reply that is a JSON list of strings as an array, null when it is anything else."""
    return F.from_json(reply, "array<string>")
