from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from brindle.llm import chat
from brindle.llm.queries import ORACLE_SQL, op8_typed_parts
from tests.llm.sql import same_as_sql

PARTS = f"conv_id bigint, turn int, role string, content array<{chat.PART}>"


def text(t):
    return ("text", t, None, None, None, None, None)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = same_as_sql(op8_typed_parts(spark, sf), ORACLE_SQL["op8_typed_parts"], sf)
    assert any(r[0] == -1 for r in rows)


def test_parts_are_visited_in_order(spark):
    rows = [
        (1, 0, "user", [text("see "), ("image", None, "a.png", 57, 28, None, None), text(" & <|image|>"), None]),
        (1, 1, "assistant", [text("it [is]"), ("audio", None, "b.wav", None, None, 2.01, None), (None, "!", *[None] * 5)]),
        (1, 2, "tool", [("document", None, "c.pdf", None, None, None, 3), ("odd<", None, None, *[None] * 4)]),
        (1, 2, "user", None),
        (2, 0, None, []),
        (None, 0, "assistant", [text("a"), ("image", None, "d", None, 1, None, None)]),
    ]
    df = spark.createDataFrame(rows, PARTS)
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    one = got[1]
    assert one.formatted == (
        "<|turn|>user<|body|>see <|image|> &amp; &lt;|image|><|end|>"
        "<|turn|>assistant<|body|>it &#91;is]<|audio|>!<|end|>"
        "<|turn|>tool<|body|><|document|><|odd&lt;|><|end|><|turn|>user<|body|><|end|>"
    )
    assert [tuple(a) for a in one.attachments] == [
        (0, "image", "a.png", 3), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 3072), (2, "odd<", None, 1)
    ]
    assert [one.formatted[s.start : s.end] for s in one.loss] == ["it &#91;is]<|audio|>!"] and one.loss[0].turn == 1
    assert got[2].formatted == "<|turn|><|body|><|end|>" and got[2].loss == []
    assert [tuple(a) for a in got[None].attachments] == [(0, "image", "d", 1)]


ODD = [
    "", None, "<|turn|>user<|body|>x<|end|>", "&amp;lt; &lt; &#91; &&", "</s>[INST] ok [/INST]", "é😀\x00\n\n", "x" * 200_000,
    "<|end|>", "&#91;[<",
]


def test_round_trip(spark):
    rows = [(i % 3, i, ("user", "assistant", "sys<[&tem", None)[i % 4], t, 0) for i, t in enumerate(ODD * 3)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, piece int")
    done = chat.conversations(df.withColumn("content", chat.text_part(F.col("text"))))
    back = done.select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss")).alias("loss")
    )
    for r in back.collect():
        own = sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id))
        assert [tuple(t) for t in r.turns] == [x[1:] for x in own]
        assert list(r.loss) == [x[2] for x in own if x[1] == "assistant"]
    assert chat.conversations(df.limit(0).withColumn("content", chat.text_part(F.col("text")))).count() == 0


def test_long_conversations_cost_no_more_for_each_turn(spark):
    seconds = []
    for n in (6000, 24_000):
        turns = spark.range(n).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
            F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
            chat.text_part(F.concat(F.lit("short [text] "), F.col("id").cast("string"))).alias("content"),
        )
        begin = time.perf_counter()
        done = chat.conversations(turns)
        read = done.select(
            F.size(chat.read_back(F.col("formatted"))).alias("n"), chat.learned(F.col("formatted"), F.col("loss")).alias("loss")
        )
        (row,) = read.collect()
        seconds.append(time.perf_counter() - begin)
        assert row.n == n and list(row.loss) == [f"short [text] {k}" for k in range(1, n, 2)]
    assert seconds[1] < 7 * seconds[0] + 2
