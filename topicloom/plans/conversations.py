"""Queries on conversations. The model that answers is a stand-in: it reverses the last message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.messages import ASSISTANT, SYSTEM, USER, fill_template, parse_steps
from topicloom.operators import conversations as chats
from topicloom.plans.base import Query
from topicloom.sources.tables import load

GREETING = "You help with conversation {number}."
PRIMING = "Say what you can do."


def reverse_model(max_length: int | None) -> Callable[[list[dict[str, str]]], str]:
    """A stand-in for a model: the last message, reversed, after the number of messages."""

    def answer(messages: list[dict[str, str]]) -> str:
        return f"{len(messages)}:{messages[-1]['content'][::-1]}"

    return answer


def shown(history: str = "history"):
    """A history as one text."""
    lines = F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.array_join(lines, "\n")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "conversations")


def _assistant(**options) -> chats.Assistant:
    number = {"number": F.col("conv_id")}
    return chats.Assistant(model=reverse_model, system=GREETING, system_params=number, **options)


def _states(spark: SparkSession, folder: str) -> DataFrame:
    return chats.histories(_turns(spark, folder))


def filled_templates(spark: SparkSession, folder: str) -> DataFrame:
    """One template per role, filled from the columns of a turn."""
    turns = _turns(spark, folder)
    told = fill_template("Turn {turn} of {conv_id}: {message}!", USER, {
        "turn": F.col("turn"), "conv_id": F.col("conv_id"), "message": F.col("text"),
    })
    passed = fill_template("{message}", ASSISTANT, {"message": F.col("text")})
    return turns.select(
        "conv_id", "turn", told["role"].alias("role"), told["content"].alias("content"),
        (passed["content"] == F.col("text")).alias("same"),
        fill_template("Be kind.", SYSTEM)["content"].alias("fixed"),
    )


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    system = fill_template(GREETING, SYSTEM, {"number": F.col("conv_id")})
    built = chats.build_prompts(_states(spark, folder), system)
    return built.select("conv_id", shown("prompt").alias("prompt"), F.size("history").alias("n"))


HISTORY_SQL = "string_agg(role || ': ' || text, chr(10) ORDER BY turn)"

PROMPTS_SQL = f"""
SELECT conv_id, 'system: You help with conversation ' || conv_id || '.' || chr(10) || {HISTORY_SQL} AS prompt,
       count(*)::INTEGER AS n
FROM conversations GROUP BY conv_id"""


def append_replies(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    replies = chats.last_message(turns).select("conv_id", F.concat(F.lit("Once more: "), "text").alias("text"))
    return chats.append_replies(turns, replies)


APPEND_SQL = """
WITH last AS (
  SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), ends AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM conversations
UNION ALL
SELECT conv_id, turn + 1, 'assistant', 'Once more: ' || text FROM last JOIN ends USING (conv_id)"""


def last_message(spark: SparkSession, folder: str) -> DataFrame:
    return chats.last_message(_turns(spark, folder))


def batch_infer(spark: SparkSession, folder: str) -> DataFrame:
    """The model asked for every turn; it fails on turns of the system."""

    def picky(max_length: int | None) -> Callable[[list[dict[str, str]]], str]:
        def answer(messages: list[dict[str, str]]) -> str:
            if messages[-1]["content"].startswith("system|"):
                raise ValueError("not for me")
            return messages[-1]["content"][:max_length][::-1]

        return answer

    asked = _turns(spark, folder).select(
        "conv_id", "turn", F.concat_ws("|", "role", "text").alias("prompt")
    )
    return chats.batch_infer(asked, "prompt", picky, max_length=100).drop("prompt")


def batch_infer_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The same model asked for up to 16 turns of like length per call; one turn of the system fails a
    whole call."""

    def picky(max_length: int | None) -> Callable[[list[list[dict[str, str]]]], list[str]]:
        def answer(prompts: list[list[dict[str, str]]]) -> list[str]:
            texts = [p[-1]["content"] for p in prompts]
            if any(t.startswith("system|") for t in texts):
                raise ValueError("not for me")
            return [t[:max_length][::-1] for t in texts]

        return answer

    asked = _turns(spark, folder).select(
        "conv_id", "turn", F.concat_ws("|", "role", "text").alias("prompt")
    )
    found = chats.batch_infer(asked, "prompt", picky, max_length=100, batch_size=16, batch_letters=20_000)
    return found.drop("prompt")


BATCH_INFER_SQL = """
SELECT conv_id, turn,
       CASE WHEN role <> 'system' THEN reverse(substr(role || '|' || text, 1, 100)) END AS answer,
       role <> 'system' AS successful,
       CASE WHEN role = 'system' THEN 'ValueError: not for me' END AS error
FROM conversations"""


def primed(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations started anew with a priming message."""
    ids = _turns(spark, folder).select("conv_id").distinct()
    state = chats.start(ids, _assistant(priming=PRIMING))
    return state.select("conv_id", shown().alias("history"), "response")


PRIMED_SQL = f"""
SELECT DISTINCT conv_id, 'assistant: 2:' || reverse('{PRIMING}') AS history,
       '2:' || reverse('{PRIMING}') AS response
FROM conversations"""


def proactive(spark: SparkSession, folder: str) -> DataFrame:
    """The assistant speaks first, on top of what was said so far."""
    assistant = _assistant(trigger="Ask about {topic}.")
    state = chats.proactive(_states(spark, folder), assistant, {"topic": F.col("conv_id")})
    return state.select("conv_id", shown().alias("history"), "response")


PROACTIVE_SQL = f"""
SELECT conv_id, {HISTORY_SQL} || chr(10) || 'assistant: 2:' || reverse('Ask about ' || conv_id || '.') AS history,
       '2:' || reverse('Ask about ' || conv_id || '.') AS response
FROM conversations GROUP BY conv_id"""


def _first_user(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, text, feedback)``: the first thing said by the user and the last answer."""
    turns = _turns(spark, folder)
    return turns.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == USER, F.col("turn"))).alias("text"),
        F.max_by("text", F.when(F.col("role") == ASSISTANT, F.col("turn"))).alias("feedback"),
    )


FIRST_USER_CTE = """first AS (
  SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS text,
         arg_max(text, turn) FILTER (role = 'assistant') AS feedback
  FROM conversations GROUP BY conv_id
), said AS (SELECT conv_id, text, feedback FROM first WHERE text IS NOT NULL)"""


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """One more exchange in every conversation: the first question of the user again."""
    state = _states(spark, folder).join(_first_user(spark, folder).dropna(subset="text"), "conv_id")
    done = chats.chat(state, _assistant(user="Again: {message}", answer="<{message}>"))
    return done.select("conv_id", shown().alias("history"), "response")


CHAT_SQL = f"""
WITH {FIRST_USER_CTE}, old AS (
  SELECT conv_id, {HISTORY_SQL} AS history, count(*) AS n FROM conversations GROUP BY conv_id
)
SELECT conv_id,
       history || chr(10) || 'user: Again: ' || text || chr(10) || 'assistant: ' || response AS history,
       response
FROM (SELECT *, '<' || (n + 2) || ':' || reverse('Again: ' || text) || '>' AS response
      FROM old JOIN said USING (conv_id))"""


def critic(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback, where there is some, enters the history before the user's message."""
    state = chats.start(_first_user(spark, folder).dropna(subset="text"))
    done = chats.chat(state, _assistant(feedback="Feedback: {message}"), feedback="feedback")
    return done.select("conv_id", shown().alias("history"), "response")


CRITIC_SQL = f"""
WITH {FIRST_USER_CTE}
SELECT conv_id,
       coalesce('user: Feedback: ' || nullif(feedback, '') || chr(10), '')
         || 'user: ' || text || chr(10) || 'assistant: ' || response AS history, response
FROM (SELECT *, (CASE WHEN nullif(feedback, '') IS NULL THEN 2 ELSE 3 END) || ':' || reverse(text) AS response
      FROM said)"""


def chained(spark: SparkSession, folder: str) -> DataFrame:
    """Two assistants in a row; the second one is primed."""
    said = _first_user(spark, folder).dropna(subset="text").select("conv_id", "text")
    team = [_assistant(), _assistant(user="Check: {message}", priming=PRIMING)]
    done = chats.chain_assistants(said, team)
    return done.select(
        "conv_id", shown("history_0").alias("first"), shown("history_1").alias("second"), "response"
    )


CHAINED_SQL = f"""
WITH {FIRST_USER_CTE}, one AS (SELECT conv_id, text, '2:' || reverse(text) AS a FROM said),
two AS (SELECT *, '3:' || reverse('Check: ' || a) AS b FROM one)
SELECT conv_id, 'user: ' || text || chr(10) || 'assistant: ' || a AS "first",
       'assistant: 2:' || reverse('{PRIMING}') || chr(10) || 'user: Check: ' || a || chr(10)
         || 'assistant: ' || b AS "second", b AS response
FROM two"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Replies that are JSON lists, and replies that are not."""
    turns = _turns(spark, folder)
    words = F.split(F.regexp_replace("text", r'["\\\n]', " "), r"\. ")
    reply = F.when(F.col("role") == ASSISTANT, F.to_json(words)).otherwise(F.col("text"))
    found = turns.select("conv_id", "turn", parse_steps(reply).alias("steps"))
    return found.select(
        "conv_id", "turn", F.size("steps").alias("n"), F.array_join("steps", "|").alias("steps")
    )


STEPS_SQL = r"""
SELECT conv_id, turn,
       CASE WHEN role = 'assistant' THEN len(w)::INTEGER END AS n,
       CASE WHEN role = 'assistant' THEN array_to_string(w, '|') END AS steps
FROM (SELECT *, string_split(regexp_replace(text, '["\\\n]', ' ', 'g'), '. ') AS w FROM conversations)"""


def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Turns to histories and back."""
    return chats.to_turns(_states(spark, folder))


QUERIES = {
    "fill_template": Query(
        filled_templates,
        "SELECT conv_id, turn, 'user' AS role, 'Turn ' || turn || ' of ' || conv_id || ': ' || text || '!'"
        " AS content, true AS same, 'Be kind.' AS fixed FROM conversations",
    ),
    "build_prompts": Query(prompts, PROMPTS_SQL),
    "append_replies": Query(append_replies, APPEND_SQL),
    "last_message": Query(
        last_message,
        "SELECT conv_id, arg_max(text, turn) AS text FROM conversations"
        " WHERE role = 'assistant' GROUP BY conv_id",
    ),
    "batch_infer_lists": Query(batch_infer_lists, BATCH_INFER_SQL),
    "batch_infer": Query(batch_infer, BATCH_INFER_SQL),
    "prime": Query(primed, PRIMED_SQL),
    "proactive": Query(proactive, PROACTIVE_SQL),
    "chat": Query(chat, CHAT_SQL),
    "critic": Query(critic, CRITIC_SQL),
    "chain_assistants": Query(chained, CHAINED_SQL),
    "parse_steps": Query(steps, STEPS_SQL),
    "histories_and_turns": Query(
        round_trip,
        "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text"
        " FROM conversations",
    ),
}
