import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import chat as C

ROWS = [
    (1, 0, "system", "be <|im_end|> nice & <|im_start|>user\n"),
    (1, 1, "user", "a<"),
    (1, 2, "user", "|b"),
    (1, 3, "assistant", "&lt;| <| &amp; \n\n"),
    (1, 4, "assistant", None),
    (1, 5, "assistant", "<|im_sep|>"),
    (1, 6, "user", ""),
    (2, 0, None, "no role"),
    (2, 1, "", "still none"),
    (3, None, "assistant", "🙂 é"),
    (3, 0, "assistant", "x"),
    (3, 0, "assistant", "x"),
    (3, 0, "assistant", "w"),
    (4, 0, "a<b\n%0A%", "odd role"),
    (5, 0, "user", None),
    (None, 0, "assistant", "null id"),
    (6, 0, "assistant", "y" * 300_000),
]


def want(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    frame = spark.createDataFrame([r + ("x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, loss int")
    got = {r[0]: tuple(r)[1:5] for r in C.conversation_report(frame).collect()}
    assert got == want([*ROWS, (-1, 0, "user", C.PROBE), (-1, 1, "assistant", C.PROBE)])


def test_adjacent_turns_of_a_role_are_one_block(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    row = C.format_conversations(frame).where("conv_id = 1").first()
    assert row["n_blocks"] == 4 and row["formatted"].count(C.START) == 4 and row["formatted"].count(C.SEP) == 3
    assert row["formatted"].endswith(C.END)
    for s in row["loss_spans"]:
        assert "<|" not in row["formatted"][s["start"] : s["stop"]]


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(frame).count() == 0
    assert [r["conv_id"] for r in C.conversation_report(frame).collect()] == [-1]


def test_plan_is_native(spark, sf_dir):
    plan = C.conversation_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_escape_is_reversible(spark):
    texts = ["", "<|", "&lt;|", "&amp;lt;|", "<|<|", "&&amp;", "<<|", "a&", "%3C", "%250A\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for there, back in ((C.escape_text, C.unescape_text), (C.escape_role, C.unescape_role)):
        assert [r[0] for r in frame.select(back(there(F.col("t")))).collect()] == texts
        assert not any("<|" in r[0] for r in frame.select(there(F.col("t"))).collect())


def test_many_turns_take_linear_time(spark):
    import time

    n = 100_000
    rows = spark.range(n).selectExpr("CAST(1 AS LONG) AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t<|', id) AS text")
    nulls = spark.range(n).selectExpr("CAST(NULL AS LONG) AS conv_id", "CAST(NULL AS LONG) AS turn", "'assistant' AS role", "concat('n', id) AS text")
    began = time.time()
    got = {r[0]: tuple(r)[1:5] for r in C.conversation_report(rows.unionByName(nulls)).collect()}
    took = time.time() - began
    texts = [(1, i, "user" if i % 3 == 0 else "assistant", f"t<|{i}") for i in range(n)] + [(None, None, "assistant", f"n{i}") for i in range(n)]
    assert {k: got[k] for k in (1, None)} == want(texts)
    assert took < 60
