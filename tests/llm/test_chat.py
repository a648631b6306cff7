import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, segments string"
pieces = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "\\", "<", "s>", "[", "a", " ", "\n", "é", "😀", "INST]", "$1"]), max_size=9).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a<s>\\b"]), pieces), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, TURNS))).first()
    assert [(t.role, t.text) for t in out.turns] == turns
    assert out.trained == "".join(t for r, t in turns if r == "assistant")
    assert out.n_turns == len(turns)


def test_machine_nulls_and_order(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, "user", None), (3, 1, None, "x"), (4, 1, "assistant", "x"), (5, 1, "system", "s"), (5, 2, "user", "u"), (5, 3, "assistant", "v"), (None, 1, "user", "q"), (6, None, "user", "a"), (6, 1, "assistant", "b")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], TURNS))).collect()}
    assert out[1].valid and out[1].formatted == "[INST]a[/INST]<s>b</s>"
    assert [(s.text, s.loss) for s in out[1].segments] == [("[INST]", False), ("a", False), ("[/INST]", False), ("<s>", False), ("b", True), ("</s>", False)]
    assert out[2].end_state == "asked" and not out[2].valid and out[2].turns[0].text == ""
    assert out[3].end_state == "error" and out[3].turns[0].role == ""
    assert not out[4].valid and out[5].valid and out[6].valid and out[None].n_turns == 1
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_bad_template(spark):
    turns = spark.createDataFrame([], TURNS)
    for mark in ("a", "aba", "a\\b"):
        with pytest.raises(ValueError):
            chat.format_chats(turns, template={"user": (mark, "[/INST]", False)})
    for closes in (("bc!", "abc"), ("cd", "abcde"), ("x<", "q>>")):
        with pytest.raises(ValueError):
            chat.format_chats(turns, template={"user": ("u[", closes[0], False), "assistant": ("v[", closes[1], True)})


def test_long_conversation(spark):
    rows = spark.range(3_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("long </s> "), 30).alias("text"))
    out = chat.read_back(chat.format_chats(rows)).select("valid", F.size("turns").alias("n"), F.sha2("trained", 256).alias("h")).first()
    assert out.valid and out.n == 3_000 and out.h == hashlib.sha256(("long </s> " * 30 * 1_500).encode()).hexdigest()
