"""Chat formatting of empty tables, clashing columns and very long texts."""

import hashlib

from acervo.llm.chat import chat_digests, format_chats, read_chats

SCHEMA = "conv_id long, turn long, role string, text string"


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_digests(none).collect() == [] and format_chats(none).columns == ["conv_id", "formatted", "loss"]


def test_clashing_columns_and_a_long_text(spark):
    long = "<|end|>\n & </s> " * 20_000
    rows = [(1, 1, "assistant", long, "a", "b", 3), (1, 0, "user", None, "a", "b", 3)]
    turns = spark.createDataFrame(rows, SCHEMA + ", id string, turns string, pieces int")
    got = chat_digests(turns).first()
    assert (got.conv_id, got.n_turns, got.loss_chars) == (1, 2, len(long))
    assert got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    back = read_chats(format_chats(turns)).first().turns
    assert [(t.role, t.text) for t in back] == [("user", ""), ("assistant", long)]
