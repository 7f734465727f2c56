import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.functions.messages import PROACTIVE_TRIGGER, fill, last_content, parse_steps
from topicloom.operators import conversations as chats
from topicloom.sources.tables import read_histories, write_histories


def echo(max_length):
    def answer(messages):
        if "fail" in messages[-1]["content"]:
            raise RuntimeError("no answer")
        return f"[{len(messages)} {messages[0]['content']}] {messages[-1]['content']}"[:max_length]

    return answer


ME = chats.Assistant(echo, "sys")


def said(df, history="history"):
    return [[(m.role, m.content) for m in r[history]] for r in df.orderBy("conv_id").collect()]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "hi"), (2, "please fail"), (3, "yo")], "conv_id long, text string")


def test_templates(spark):
    df = spark.createDataFrame([("x", 3)], "a string, b int")
    found = df.select(fill("{a}-{b}-{a}", {"a": F.col("a"), "b": F.col("b")}).alias("t"), fill("{").alias("u"))
    assert tuple(found.first()) == ("x-3-x", "{")
    with pytest.raises(ValueError, match="name"):
        fill("{name}")


def test_exchange(users):
    done = chats.chat(chats.start(users), ME).cache()
    assert said(done) == [
        [("user", "hi"), ("assistant", "[2 sys] hi")],
        [("user", "please fail")],
        [("user", "yo"), ("assistant", "[2 sys] yo")],
    ]
    assert [r.response for r in done.orderBy("conv_id").collect()] == ["[2 sys] hi", None, "[2 sys] yo"]
    assert [r.error for r in done.orderBy("conv_id").collect()] == [None, "RuntimeError: no answer", None]
    # The system message is not stored, the history grows.
    more = chats.chat(done.where("conv_id = 1"), ME)
    assert said(more)[0][-1] == ("assistant", "[4 sys] hi")
    assert more.select(last_content(F.col("history"))).first()[0] == "[4 sys] hi"


def test_priming(users):
    assistant = chats.Assistant(echo, "sys", priming="wake up")
    begun = chats.start(users.where("conv_id = 1"), assistant)
    assert said(begun) == [[("assistant", "[2 sys] wake up")]]
    assert said(chats.start(chats.chat(begun, assistant), assistant)) == said(begun)
    with pytest.raises(ValueError):
        chats.prime(begun, ME)


def test_proactive(users):
    asked = chats.proactive(chats.start(users.where("conv_id = 1")), ME)
    assert said(asked) == [[("assistant", f"[2 sys] {PROACTIVE_TRIGGER}")]]


def test_feedback(spark):
    df = spark.createDataFrame([(1, "a", "bad"), (2, "b", ""), (3, "c", None)], "conv_id long, text string, f string")
    done = chats.chat(chats.start(df), ME, feedback="f")
    assert [[role for role, _ in h] for h in said(done)] == [
        ["user", "user", "assistant"], ["user", "assistant"], ["user", "assistant"],
    ]
    assert said(done)[0][0] == ("user", "bad")


def test_parameters(users):
    assistant = chats.Assistant(echo, "for {who}", user="Q: {message} ({n})", system_params={"who": F.lit("all")})
    done = chats.chat(
        chats.start(users.where("conv_id = 1")), assistant, user_params={"n": F.col("conv_id")},
        system_params={"who": F.col("text")},
    )
    assert said(done) == [[("user", "Q: hi (1)"), ("assistant", "[2 for hi] Q: hi (1)")]]


def test_chain(users):
    done = chats.chain_assistants(users, [ME, chats.Assistant(echo, "second")])
    assert said(done, "history_1")[0] == [("user", "[2 sys] hi"), ("assistant", "[2 second] [2 sys] hi")]
    # A failed stage passes no message on.
    failed = done.where("conv_id = 2").first()
    assert failed.response is None and not failed.successful


def test_limit_and_spread(users):
    asked = chats.batch_infer(users, "text", echo, max_length=4, tasks=3)
    assert [r.answer for r in asked.orderBy("conv_id").collect()] == ["[1 h", None, "[1 y"]


def test_steps(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("__import__('os')",), ("[1, ",), ("[]",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_steps(F.col("t"))).collect()] == [["a", "b"], None, None, [], None]


def test_replies_and_files(spark, users, tmp_path):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q")],
        "conv_id long, turn long, role string, text string",
    )
    replies = spark.createDataFrame([(1, "r"), (7, "new")], "conv_id long, text string")
    grown = chats.append_replies(turns, replies)
    assert (1, 2, "assistant", "r") in rows(grown) and (7, 0, "assistant", "new") in rows(grown)
    assert rows(chats.last_message(grown)) == [(1, "r"), (7, "new")]
    state = chats.histories(grown)
    path = str(tmp_path / "h")
    write_histories(state, path)
    assert rows(chats.to_turns(read_histories(spark, path))) == rows(grown)
    line = spark.read.text(path).orderBy("value").first()[0]
    assert json.loads(line)["history"][0] == {"role": "user", "content": "q"}
