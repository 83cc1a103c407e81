from pyspark.sql import functions as F

from hearth.llm import chat as C
from hearth.llm.q_chat import OP8_SQL, op8_chat_format
from oracle import assert_same

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>", "<\\/s>", "<\\\\s>", "[INST] [/INST]", "[\\INST]", "", "a</s>[/ROLE] b", "<s><s>", "[[SYS]]", "汉字 🙂 \n", "$1 \\ $"]


def test_matches_oracle(spark, sf):
    assert_same(op8_chat_format(spark, sf), sf, OP8_SQL)


def test_round_trip_of_control_strings(spark):
    rows = [(i, 2 * k + j, role, text) for i, text in enumerate(ODD) for k in (0, 1) for j, role in enumerate(("user", "assistant"))]
    rows += [(100, 0, "tool</s>[/ROLE] ", "x [/ROLE] y"), (100, 1, "", "z"), (100, 2, "system", "s"), (101, 0, None, None)]
    out = C.format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", C.read_back(F.col("formatted")))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.collect()}
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got == want


def test_loss_flags_and_turn_order(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "q"), (1, 3, "assistant", "two"), (2, 0, "assistant", "x"), (3, 0, "system", "s"), (3, 1, "user", "u"), (4, 0, "user", "a"), (4, 1, "user", "b"), (None, 0, "user", "n")]
    out = {r["conv_id"]: r for r in C.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [s["text"] for s in out[1]["segments"] if s["loss"]] == ["one", "two"]
    assert {k: r["valid"] for k, r in out.items()} == {1: True, 2: False, 3: False, 4: False, None: False}
    assert "".join(s["text"] for s in out[1]["segments"]) == out[1]["formatted"]


def test_repeated_rows_extra_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q")] * 2, SCHEMA).withColumns({c: F.lit(1) for c in ("t", "turns", "segments", "formatted")})
    assert C.format_chats(rows).first()["n_turns"] == 2
    assert C.format_chats(rows.filter("false")).count() == 0
