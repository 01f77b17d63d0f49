"""Chat formatting with Spark expressions only.

A conversation becomes one string. Each run of turns with the same role is a block:

    <|turn|>ROLE\\nTEXT<|more|>TEXT<|end|>\\n

Within roles and texts, & < and (in roles) line breaks are written as &amp; &lt; &#10;, so no text can hold a control
string, and reading back gives the turns as they were. The loss mask is a list of (start, length) in code points of the
formatted string: one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, MORE, END = "<|turn|>", "<|more|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", trained: str = "assistant") -> DataFrame:
    """(id_column, formatted, loss): one row for each conversation; loss is array<struct<start,length>>, start from 0.

    Turns are sorted by turn, then role and text, nulls first. Null roles and texts are empty. Rows with a null id are one
    conversation. Repeated rows are turns of their own. Other columns are not read. An empty table gives an empty one.
    """
    rows = turns.select(F.col(id_column).alias("id"), F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    at = lambda i: F.get("turns", i)["role"]
    head = lambda t, i: F.when((i > 0) & (at(i - 1) == t["role"]), F.lit(MORE)).otherwise(F.concat(F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n")))
    tail = lambda t, i: F.when(at(i + 1) == t["role"], F.lit("")).otherwise(F.lit(END))
    chats = chats.withColumn("pieces", F.transform("turns", lambda t, i: F.struct(head(t, i).alias("head"), escape(t["text"]).alias("body"), tail(t, i).alias("tail"), (t["role"] == trained).alias("loss"))))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("found")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long").alias("at"),
            F.when(p["loss"], F.array_append(a["found"], F.struct((a["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return chats.select(F.col("id").alias(id_column), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), spans.alias("loss"))


def read_chats(chats: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id_column, formatted, loss) -> (id_column, turns array<struct<role,text>>, loss_text, formatted), read from the formatted string."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(F.substring(b, F.lit(len(TURN) + 1), F.length(b)), "\n", 1))
    body = lambda b: F.substring(b, F.instr(b, "\n") + 1, F.length(b))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|more\|>"), lambda x: F.struct(role(b).alias("role"), unescape(x).alias("text")))))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.select(id_column, turns.alias("turns"), loss.alias("loss_text"), "formatted")


def chat_digests(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id_column, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted strings."""
    back = read_chats(format_chats(turns, id_column), id_column)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(id_column, F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
