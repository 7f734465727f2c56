"""Conversation steps in batch: prompts, replies, priming, feedback, chains.

State is one row per conversation with its ``history``; a step is a projection around one call of
the user's model. Turn tables are turned into histories and back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.messages import (
    ASSISTANT,
    HISTORY,
    PASS_THROUGH,
    PROACTIVE_TRIGGER,
    SYSTEM,
    USER,
    fill_template,
    message,
    no_history,
)
from topicloom.operators.columns import per_batch, per_row
from topicloom.operators.skew import SLICE, Slices, as_list, find_slices

#: Makes a model: called once per task with the length limit, returns a function from a list of
#: messages (dicts of role and content) to the answer.
ModelFactory = Callable[[int | None], Callable[[list[dict[str, str]]], str]]

#: The same for a model that takes many prompts per call, each a list of messages, and gives a list of answers.
BatchModelFactory = Callable[[int | None], Callable[[list[list[dict[str, str]]]], Sequence[str]]]

# Fixed value: the longest answer a model may give unless told otherwise.
MAX_LENGTH = 700


def histories(
    turns: DataFrame,
    key: str | Sequence[str] = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    slices: Slices | None = None,
) -> DataFrame:
    """``(key, history)`` from one row per turn; frequent keys are collected slice by slice."""
    key = as_list(key)
    slices = find_slices(turns, key, order) if slices is None else slices
    item = F.struct(F.col(order).alias("at"), message(F.col(role), F.col(text)).alias("m"))

    def ordered(rows: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(rows)), lambda r: r["m"])

    if not slices.hot:
        return turns.groupBy(*key).agg(ordered(item).alias("history"))
    cut = turns.withColumn(SLICE, slices.column(key, order))
    parts = cut.groupBy(*key, SLICE).agg(ordered(item).alias("m"))
    whole = F.flatten(ordered(F.struct(SLICE, "m")))
    return parts.groupBy(*key).agg(whole.alias("history"))


def to_turns(state: DataFrame, key: str | Sequence[str] = "conv_id") -> DataFrame:
    """One row per message again: ``(key, turn, role, text)``."""
    rows = state.select(*as_list(key), F.posexplode("history").alias("turn", "m"))
    return rows.select(
        *as_list(key), F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("text"),
    )


def build_prompts(
    state: DataFrame, system: Column, history: str = "history", out: str = "prompt"
) -> DataFrame:
    """The system message before the history, which does not store it."""
    return state.withColumn(out, F.concat(F.array(system), F.col(history)).cast(HISTORY))


def append_message(state: DataFrame, added: Column, history: str = "history") -> DataFrame:
    return state.withColumn(history, F.concat(F.col(history), F.array(added)).cast(HISTORY))


def append_replies(turns: DataFrame, replies: DataFrame, key: str = "conv_id") -> DataFrame:
    """Add ``(key, text)`` answers to a turn table as the next turn of their conversations."""
    last = turns.groupBy(key).agg(F.max("turn").alias("turn"))
    new = replies.join(last, key, "left").select(
        key,
        (F.coalesce("turn", F.lit(-1)) + 1).cast("long").alias("turn"),
        F.lit(ASSISTANT).alias("role"),
        "text",
    )
    return turns.select(key, "turn", "role", "text").unionByName(new)


def last_message(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, text)``: the last answer in each conversation."""
    answers = turns.where(F.col("role") == ASSISTANT)
    return answers.groupBy(key).agg(F.max_by("text", "turn").alias("text"))


def batch_infer(
    df: DataFrame,
    prompt: str,
    model: ModelFactory | BatchModelFactory,
    out: str = "answer",
    max_length: int | None = MAX_LENGTH,
    tasks: int | None = None,
    batch_size: int | None = None,
    batch_letters: int | None = None,
) -> DataFrame:
    """Ask the model for every row; adds the answer, ``successful`` and ``error``.

    The model is made once per task. ``prompt`` holds messages, or a text that is sent as the only
    user message. A failure ends only its own row. ``tasks`` spreads the rows over as many calls.

    With ``batch_size`` the model takes a list of prompts per call and answers with a list. Prompts of
    like length go together; ``batch_letters`` limits the letters of a call, its prompts counted as long
    as the longest. A call that fails is made again for its halves, so that one bad prompt fails alone.
    """
    is_text = isinstance(df.schema[prompt].dataType, T.StringType)

    def messages(value: Any) -> list[dict[str, str]]:
        if is_text:
            return [{"role": USER, "content": value}]
        return [{"role": m["role"], "content": m["content"]} for m in value]

    def letters(value: Any) -> int:
        return sum(len(m["content"] or "") for m in messages(value))

    spread = df if tasks is None else df.repartition(tasks)
    if batch_size is None:

        def make() -> Callable[[Any], str]:
            chat = model(max_length)
            return lambda value: chat(messages(value))

        return per_row(spread, prompt, make, out)

    def make_batches() -> Callable[[list[Any]], Sequence[Any]]:
        chat = model(max_length)
        return lambda values: chat([messages(v) for v in values])

    return per_batch(spread, prompt, make_batches, batch_size, letters, batch_letters, out)


@dataclass(frozen=True)
class Assistant:
    """What a conversation step needs to know about the one who answers."""

    model: ModelFactory | BatchModelFactory
    system: str
    user: str = PASS_THROUGH
    answer: str = PASS_THROUGH
    feedback: str = PASS_THROUGH
    system_params: dict[str, Column] = field(default_factory=dict)
    priming: str | None = None
    trigger: str = PROACTIVE_TRIGGER
    max_length: int | None = MAX_LENGTH
    tasks: int | None = None
    batch_size: int | None = None
    batch_letters: int | None = None

    def system_message(self, params: dict[str, Column] | None = None) -> Column:
        return fill_template(self.system, SYSTEM, params or self.system_params)


def _asked(state: DataFrame, assistant: Assistant, prompt: Column, history: str) -> DataFrame:
    """Send a prompt; the answer goes to the history and to ``response``."""
    asked = state.withColumn("__prompt", prompt.cast(HISTORY))
    answered = batch_infer(
        asked, "__prompt", assistant.model, "__answer", assistant.max_length, assistant.tasks,
        assistant.batch_size, assistant.batch_letters,
    )
    reply = fill_template(assistant.answer, ASSISTANT, {"message": F.col("__answer")})
    # A failed call leaves the history as it was.
    grown = F.when(F.col("successful"), F.concat(F.col(history), F.array(reply))).otherwise(F.col(history))
    response = F.when(F.col("successful"), reply["content"])
    return (
        answered.withColumn(history, grown.cast(HISTORY))
        .withColumn("response", response)
        .drop("__prompt", "__answer")
    )


def start(df: DataFrame, assistant: Assistant | None = None, history: str = "history") -> DataFrame:
    """Empty histories, primed if the assistant has a priming message. Also resets a state."""
    fresh = df.withColumn(history, no_history())
    return fresh if assistant is None or not assistant.priming else prime(fresh, assistant, history)


def prime(state: DataFrame, assistant: Assistant, history: str = "history") -> DataFrame:
    """Send system and priming message; only the answer enters the history."""
    if not assistant.priming:
        raise ValueError("the assistant has no priming message")
    prompt = F.array(assistant.system_message(), message(USER, F.lit(assistant.priming)))
    return _asked(state, assistant, prompt, history)


def proactive(
    state: DataFrame,
    assistant: Assistant,
    params: dict[str, Column] | None = None,
    history: str = "history",
) -> DataFrame:
    """Let the assistant speak first; only the answer enters the history."""
    trigger = fill_template(assistant.trigger, USER, params)
    return _asked(state, assistant, F.array(assistant.system_message(), trigger), history)


def chat(
    state: DataFrame,
    assistant: Assistant,
    text: str = "text",
    user_params: dict[str, Column] | None = None,
    system_params: dict[str, Column] | None = None,
    feedback: str | None = None,
    history: str = "history",
) -> DataFrame:
    """One exchange: the user's message enters the history, the model sees system and history.

    ``feedback`` names a column whose non-empty values enter the history first (a critic's turn).
    """
    user_params = user_params or {}
    if feedback is not None:
        given = F.coalesce(F.col(feedback), F.lit("")) != ""
        told = fill_template(assistant.feedback, USER, {**user_params, "message": F.col(feedback)})
        noted = F.when(given, F.concat(F.col(history), F.array(told))).otherwise(F.col(history))
        state = state.withColumn(history, noted.cast(HISTORY))
    said = fill_template(assistant.user, USER, {**user_params, "message": F.col(text)})
    state = append_message(state, said, history)
    prompt = F.concat(F.array(assistant.system_message(system_params)), F.col(history))
    return _asked(state, assistant, prompt, history)


def chain_assistants(
    df: DataFrame, assistants: Sequence[Assistant], text: str = "text"
) -> DataFrame:
    """The answer of each assistant is the message to the next.

    Adds the last ``response`` and ``history_0``, ``history_1``, ... with what each one said. A
    failed stage gives no message to the next, which then fails too.
    """
    state = df.withColumn("response", F.col(text))
    for place, assistant in enumerate(assistants):
        name = f"history_{place}"
        state = state.withColumn("__message", F.col("response"))
        state = chat(start(state, assistant, name), assistant, "__message", history=name)
    return state.drop("__message")
