"""Chat formatting: round trips, the loss mask and the order of roles."""

import random

import pytest
from pyspark.sql import functions as F

from burnish.llm.chat import ChatTemplate, escaped, format_conversations, learned_text, turns_of, unescaped

BITS_OF_MARKS = ["\\", "###", "#", "</turn>", "</tu", "rn>", "\n", ": ", ":", " ", "h", "t", "c", "word", "é🤦", "### User: "]
SCHEMA = "conv_id bigint, turn int, role string, text string, _turns int, segments int, state int, formatted int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def read(df, template=None):
    out = format_conversations(df, template)
    back = out.select("*", turns_of(F.col("formatted"), template).alias("turns"), learned_text(F.col("segments"), template).alias("learned"))
    return {r.conv_id: r for r in back.collect()}


def test_texts_of_marks_come_back(spark):
    rng = random.Random(1)
    some = lambda: "".join(rng.choice(BITS_OF_MARKS) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["system", "user", "assistant"]), some()) for c in range(60) for t in range(rng.randint(1, 7))]
    got = read(table(spark, rows))
    for c, r in got.items():
        own = [(role, text) for k, _, role, text in rows if k == c]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.learned == "".join(text for role, text in own if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("</turn>") == len(own) and r.formatted.count("###") == len(own)
        learned = [s for s in r.segments if s.loss]
        assert len(learned) == sum(role == "assistant" for role, _ in own)


def test_escapes_alone_come_back(spark):
    rng = random.Random(2)
    texts = [("".join(rng.choice(BITS_OF_MARKS) for _ in range(rng.randint(0, 20))),) for _ in range(300)]
    t = ChatTemplate()
    df = spark.createDataFrame(texts, "x string")
    for in_role in (False, True):
        for r in df.select("x", escaped(F.col("x"), t, in_role).alias("e")).withColumn("b", unescaped(F.col("e"), t, in_role)).collect():
            assert r.b == r.x and "###" not in r.e and "</turn>" not in r.e


def test_roles_out_of_order_are_refused_and_written(spark):
    orders = {
        1: (["system", "user", "assistant"], "answered", None),
        2: (["user", "assistant", "user"], "asked", None),
        3: (["user", "user", "assistant"], "refused", 2),
        4: (["assistant"], "refused", 1),
        5: (["user", "assistant", "system", "user"], "refused", 3),
        6: (["user", "tool: x\\", "assistant"], "refused", 2),
        7: (["user", None], "refused", 2),
        8: (["user", ""], "refused", 2),
        9: (["system"], "briefed", None),
    }
    rows = [(c, i, role, f"text {i}") for c, (roles, _, _) in orders.items() for i, role in enumerate(roles)]
    got = read(table(spark, rows))
    for c, (roles, state, bad) in orders.items():
        assert (got[c].state, got[c].bad_turn) == (state, bad)
        assert [t.role for t in got[c].turns] == roles


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (1, None, "user", "first"), (1, 2, "user", "b"), (1, 2, "assistant", "z"), (1, 2, "user", "b")]
    got = read(table(spark, rows))
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "a"), ("assistant", "")]
    assert got[None].learned == "" and got[None].state == "answered"
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("assistant", "z"), ("user", "b"), ("user", "b")]


def test_long_texts_and_many_turns(spark):
    long = "### \\ </turn> word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, ("user", "assistant")[i % 2], f"{i}") for i in range(3000)]
    got = read(table(spark, rows))
    assert [t.text for t in got[1].turns] == [long, long] and got[1].learned == long
    assert len(got[2].turns) == 3000 and got[2].state == "answered"


def test_another_template(spark):
    t = ChatTemplate(
        labels={"human": "H", "bot": "B"}, learned=("human", "bot"), head="[|", colon="|] ", tail="<end>",
        control={"[|": "o", "<end>": "e", "|] ": "m"}, in_roles_only=(), moves={"start": {"human": "h"}, "h": {"bot": "start"}},
    )
    rows = [(1, 0, "human", "[|B|] <end> \\e"), (1, 1, "bot", "ok")]
    got = read(table(spark, rows), t)[1]
    assert [(x.role, x.text) for x in got.turns] == [(r[2], r[3]) for r in rows]
    assert got.learned == rows[0][3] + "ok" and got.state == "start" and got.formatted.startswith("[|H|] ")


def test_empty_tables_and_plans_without_python(spark):
    df = table(spark, [(1, 0, "user", "x")])
    assert format_conversations(df.filter("turn > 5")).count() == 0
    plan = format_conversations(spark.range(3).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")))
    assert not any(w in plan._jdf.queryExecution().toString() for w in ("Python", "Pandas", "ExistingRDD"))


@pytest.mark.parametrize("column", ["conv_id", "turn", "role", "text"])
def test_a_null_in_any_column(spark, column):
    df = table(spark, [(1, 0, "user", "x"), (1, 1, "assistant", "y")]).withColumn(column, F.lit(None).cast({"conv_id": "bigint", "turn": "int"}.get(column, "string")))
    assert sum(len(r.turns) for r in read(df).values()) == 2
