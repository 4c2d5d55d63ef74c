from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("depth", F.lit(0))
    return C.read_back(C.format_threads(C.flat_threads(df))).collect()


def test_nulls_ties_and_control_strings(spark):
    rows = [
        (1, 0, "user", "</s>[INST] \\l \\\\b ]"), (1, 1, "assistant", "<s>[ROLE x]\\"), (1, 1, "assistant", "<s>[ROLE x]\\"),
        (2, None, None, None), (2, 5, "a]b[<\\", "x"), (None, 1, "assistant", "null id"), (3, 1, "assistant", "q" * 200_000),
    ]
    got = {r["conv_id"]: r for r in run(spark, rows)}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3]) for r in rows[:3]]
    assert got[1]["loss_text"] == "<s>[ROLE x]\\" * 2
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("a]b[<\\", "x")]
    assert got[2]["loss_text"] == "" and got[None]["loss_text"] == "null id"
    assert got[3]["loss_text"] == "q" * 200_000
    assert run(spark, []) == []


def test_branches_of_a_tree(spark):
    nodes = [
        (1, 1, None, 0.0, "user", "q"), (1, 2, 1, 0.1, "assistant", "low"), (1, 3, 1, 0.9, "assistant", "high"),
        (1, 4, 3, 0.5, "user", "more"), (1, 5, 4, 0.5, "assistant", "end"), (1, 6, 99, 0.9, "user", "orphan"),
        (2, 1, 2, 0.0, "user", "cycle"), (2, 2, 1, 0.0, "user", "cycle"),
    ]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double, role string, text string")
    back = C.read_back(C.format_threads(df, per_tree=3)).collect()
    paths = {r["branch"]: [t["text"] for t in r["turns"]] for r in back}
    assert paths == {6: ["orphan"], 5: ["q", "high", "more", "end"], 2: ["q", "low"]}
    one = C.branches(df).collect()  # one branch of each tree, also where a conversation has several trees
    assert {r["branch"] for r in one} == {5, 6}


def test_long_thread(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    (got,) = run(spark, rows)
    assert [t["text"] for t in got["turns"]] == [f"t{i}" for i in range(70)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<>[]\\/slbe \n", max_size=30), min_size=1, max_size=40))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("b"), C.unescape(C.escape_role(F.col("t"))).alias("r")).collect()
    assert all(r["t"] == r["b"] == r["r"] and "<" not in r["e"] and "[" not in r["e"] for r in got)
