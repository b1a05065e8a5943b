import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import templates as D
from siltstone.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def mine(spark, lines, passes=1, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, msg string")
    out = (D.mine_templates if passes == 1 else D.assign_templates)(df, ["n"], **options)
    return [(r["template_id"], r["text"]) for r in out.orderBy("n").collect()]


def model(lines, separators=(" ",), wildcard=r"^\d+$", threshold=0.3, passes=1):
    """One loop over all lines."""
    templates, out = [], []
    for _ in range(passes):
        out = []
        for line in lines:
            tokens = [D.STAR if re.search(wildcard, t) else t for t in re.split("[" + "".join(map(re.escape, separators)) + "]", line)]
            best, at = 0.0, None
            for i, known in enumerate(templates):
                if len(known) == len(tokens) and founders[i] == tokens[0]:
                    score = sum(a == b for a, b in zip(known, tokens, strict=True)) / len(tokens)
                    if score > best:
                        best, at = score, i
            if not templates:
                founders = []
            if at is not None and best > threshold:
                templates[at] = [a if a == b else D.STAR for a, b in zip(templates[at], tokens, strict=True)]
            else:
                templates.append(tokens)
                founders.append(tokens[0])
                at = len(templates) - 1
            out.append((at + 1, " ".join(templates[at])))
    return out


@pytest.mark.parametrize(("lines", "options"), [
    (["disk full", "disk ok", "disk full", "disk slow"], {}),
    (["17 jobs done", "4 jobs done", "99 jobs done"], {}),
    (["12:05 door open", "23:59 door open", "00:00 door shut"], {"wildcard": r"^\d\d:\d\d$"}),
    (["fan|high speed", "fan|low speed"], {"separators": ("|", " ")}),
])
def test_one_template(spark, lines, options):
    assert [i for i, _ in mine(spark, lines, **options)] == [1] * len(lines)


def test_order_of_ids(spark):
    lines = ["a b c d e f g h", "x y", "a q r s t u v w", "x z", "", "a  b"]
    assert mine(spark, lines) == model(lines)
    assert mine(spark, []) == []
    with pytest.raises(ValueError):
        mine(spark, ["a"], separators=("ab",))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "7", "d"]), min_size=1, max_size=7).map(" ".join), min_size=1, max_size=40))
def test_model(spark, lines):
    assert mine(spark, lines) == model(lines)
    assert mine(spark, lines, 2, separators=(" ",), wildcard=r"^\d+$") == model(lines, passes=2)


@pytest.mark.parametrize("passes", [1, 2])
def test_blocks_change_nothing(spark, monkeypatch, passes):
    """Hot and small groups, lines that change templates early and late, blocks of few lines or characters, carried columns."""
    rnd = random.Random(passes)
    lines = [f"hot {rnd.choice('abcdef')} {rnd.choice('xyz')} {i % 3 if i < 900 else 'late'} end of line {rnd.choice(['a', 'b'])} q" for i in range(1_200)]
    lines += [" ".join(rnd.choice(["a", "b", "9", "c d"]) for _ in range(rnd.randint(1, 9))) for _ in range(300)] + ["", "w" * 300, None] * 3
    rnd.shuffle(lines)
    monkeypatch.setattr(D, "BLOCK_LINES", 37)
    monkeypatch.setattr(D, "BLOCK_CHARS", 900)
    df = spark.createDataFrame([(i, m, f"c{i}") for i, m in enumerate(lines)], "n int, msg string, extra string").repartition(5)
    out = (D.mine_templates if passes == 1 else D.assign_templates)(df, ["n"], separators=(" ",), wildcard=r"^\d+$", carry=("extra",), with_tokens=True).orderBy("n").collect()
    assert [(r["template_id"], r["text"]) for r in out] == model([m or "" for m in lines], passes=passes)
    assert all(r["extra"] == f"c{r['n']}" and " ".join(r["tokens"]) == r["text"] for r in out)


def test_hot_group_is_many_tasks(spark):
    """A million lines of one group: cut and written out by several tasks; the replay sees distinct lines only."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select("id", F.concat(F.lit("job "), F.col("id").cast("string"), F.lit(" state "), (F.col("id") % 7 * F.when(F.col("id") > 400_000, 1).otherwise(0)).cast("string"), F.lit("x ok")).alias("msg"))
    out = D.mine_templates(df, ["id"])
    got = out.groupBy("template_id", "text").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.max("id").alias("high")).collect()
    assert sorted((r["template_id"], r["text"], r["c"], r["low"], r["high"]) for r in got) == [(1, "job * state * ok", n - 400_002, 400_002, n - 1), (1, "job * state 0x ok", 400_002, 0, 400_001)]
    assert out.rdd.getNumPartitions() >= 4


def test_conversations(spark):
    """d2 on the whole table against one loop over all lines."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").toPandas()
    got = QUERIES["d2_assign_templates"](spark, SF_DIR).toPandas()
    assert len(got) == len(turns)
    order = got.sort_values(["conv_id", "turn", "again"])
    rows = turns.assign(_t=turns["text"].fillna(""), _r=turns["role"].fillna("")).sort_values(["conv_id", "turn", "_r", "_t"])
    expected = model(rows["_t"].tolist(), D.CLI_SEPARATORS, D.CLI_WILDCARD, passes=2)
    assert list(zip(order["template_id"].tolist(), order["text"].tolist(), strict=True)) == expected


def test_templates_table(spark):
    df = spark.createDataFrame([(0, "user created now"), (1, "user created then")], "n int, msg string")
    out = D.templates(D.mine_templates(df, ["n"], with_tokens=True), ["n"]).collect()
    assert [(r["template_id"], r["tokens"]) for r in out] == [(1, ["user", "created", "*"])]
    df = spark.createDataFrame([(0, "a b,c d"), (1, "a b,e f")], "n int, msg string")
    out = D.templates(D.mine_templates(df, ["n"], separators=(",",), with_tokens=True), ["n"]).collect()
    assert [(r["template_id"], r["tokens"]) for r in out] == [(1, ["a b", "*"])]
