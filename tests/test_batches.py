"""Calls that take many prompts: batches of like length, halves on failure."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.operators import columns
from topicloom.operators import conversations as chats


class Counting:
    """Answers a list in upper case, fails on lists that hold a bad item, and keeps its calls."""

    def __init__(self, bad=(), short=False):
        self.calls, self.bad, self.short = [], set(bad), short

    def __call__(self, items):
        self.calls.append(list(items))
        if self.bad & set(items):
            raise RuntimeError("bad item")
        answers = [i.upper() for i in items]
        return answers[:-1] if self.short and len(items) > 1 else answers


def test_one_call_when_all_is_well():
    model = Counting()
    assert columns.ask_together(model, ["a", "b", "c"]) == [("A", True, None), ("B", True, None), ("C", True, None)]
    assert len(model.calls) == 1
    assert columns.ask_together(model, []) == [] and len(model.calls) == 1


def test_a_bad_item_fails_alone():
    items = [f"i{n}" for n in range(64)]
    model = Counting(bad=["i37"])
    found = columns.ask_together(model, items)
    assert [i for i, r in zip(items, found, strict=True) if not r[1]] == ["i37"]
    assert found[37] == (None, False, "RuntimeError: bad item") and found[36] == ("I36", True, None)
    assert len(model.calls) == 1 + 2 * 6


def test_wrong_number_of_answers():
    found = columns.ask_together(Counting(short=True), ["a", "b", "c"])
    assert [r[0] for r in found] == ["A", "B", "C"]


def test_an_answer_may_be_an_exception():
    calls = []

    def model(items):
        calls.append(items)
        return [KeyError(i) if i == "b" else i for i in items]

    found = columns.ask_together(model, ["a", "b", "c"])
    assert [r[1] for r in found] == [True, False, True] and found[1][2] == "KeyError: 'b'"
    assert len(calls) == 1


def test_batches_of_like_length():
    lengths = [5, 1, 9, 1, 2, 100, 0]
    found = columns.batches_of_like_length(lengths, 3, padded=20)
    assert sorted(i for b in found for i in b) == list(range(7))
    assert [[lengths[i] for i in b] for b in found] == [[0, 1, 1], [2, 5], [9], [100]]
    assert columns.batches_of_like_length([], 3) == []
    with pytest.raises(ValueError):
        columns.batches_of_like_length([1], 0)


def batched(max_length):
    def answer(prompts):
        if any("fail" in p[-1]["content"] for p in prompts):
            raise RuntimeError("no answer")
        return [f"{len(p)}:{p[-1]['content']}"[:max_length] for p in prompts]

    return answer


def test_same_rows_as_one_by_one(spark):
    def single(max_length):
        return lambda messages: batched(max_length)([messages])[0]

    data = [(i, None if i == 3 else ("please fail" if i % 10 == 7 else "word " * (i % 5))) for i in range(40)]
    df = spark.createDataFrame(data, "id int, text string").repartition(3)
    one = chats.batch_infer(df, "text", single, max_length=12)
    for size in (1, 7, 1000):
        many = chats.batch_infer(df, "text", batched, max_length=12, batch_size=size, batch_letters=50)
        assert many.columns == one.columns and rows(many) == rows(one)


def test_assistant_that_takes_lists(spark):
    users = spark.createDataFrame([(1, "hi"), (2, "please fail"), (3, "yo")], "conv_id long, text string")
    me = chats.Assistant(batched, "sys", batch_size=8)
    done = chats.chat(chats.start(users), me)
    assert rows(done, "conv_id", "response") == [(1, "2:hi"), (2, None), (3, "2:yo")]
    assert done.where(F.size("history") == 1).count() == 1
