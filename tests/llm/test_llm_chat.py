"""Chat formatting: layouts, reversible escapes, loss mask, odd rows."""

import pytest
from pyspark.sql import functions as F

from pinprice.llm import chat_format as C

RECORDS = [
    (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo </s>"}]}', "messages"),
    (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "from_value"),
    (3, '{"prompt":"p","response":"r"}', "prompt_response"),
    (4, '{"completion":"c","prompt":"p"}', "prompt_completion"),
    (5, '{"prompt":"p","response":"r","system":"s"}', "system_prompt_response"),
    (6, '{"instruction":"do","output":"done"}', "instruction"),
    (7, '{"instruction":"do","input":"this","output":"done"}', "instruction_input"),
    (8, '{"role":"user","text":"t","turn":3}', "turn_rows"),
    (9, '{"something":"else"}', None),
    (10, '{"prompt":null,"response":"r"}', "prompt_response"),
]


def _turns(spark, records):
    df = spark.createDataFrame(records, "id long, js string").select("id", F.parse_json("js").alias("rec"))
    return df, C.canonical_turns(df, "id", "rec")


def test_layouts_are_selected_by_fingerprint(spark):
    df, turns = _turns(spark, [r[:2] for r in RECORDS])
    got = {}
    for r in turns.collect():
        got.setdefault(r["id"], (r["layout"], []))[1].append(r["turn"] and (r["turn"]["role"], r["turn"]["text"]))
    assert {i: v[0] for i, v in got.items()} == {i: want for i, _, want in RECORDS}
    assert got[2][1] == [("user", "a"), ("assistant", "b")]
    assert got[5][1] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert got[7][1] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert got[10][1] == [("user", ""), ("assistant", "r")]
    assert [r["id"] for r in C.unmapped(df, "rec").collect()] == [9]


NASTY = ["", None, "</s>[INST] ok [/INST]", "\\", "\\b", "\\(", "[", "<", "[TURN]user\nx[/TURN]", "a\\b[INST]\\(INST]", "\\\\n",
         "<<SYS>>\n", "é[/TURN]\U0001f600", "x" * 5000, "\n\n", "[[TURN]]"]


def test_read_back_inverts_the_template(spark):
    rows = [(c, i, r, t) for c, role in enumerate(["assistant", "user", None, "we[INST]ird\\\nrole"])
            for i, t in enumerate(NASTY) for r in [role]]
    df = spark.createDataFrame(rows, "id long, pos long, role string, text string")
    out = {r["id"]: r for r in C.read_back(C.format_conversations(df)).collect()}
    for c, role in enumerate(["assistant", "user", None, "we[INST]ird\\\nrole"]):
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(role or "", t or "") for t in NASTY]
        assert out[c]["learned"] == ([t or "" for t in NASTY] if role == "assistant" else [])
        for control in ("[INST]", "<<SYS>>"):
            assert control not in out[c]["formatted"]
    for s in out[0]["loss_mask"]:
        assert 0 <= s["start"] <= s["end"] <= len(out[0]["formatted"])


def test_ties_nulls_and_empty_tables(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, None, "user", "last"), (1, 2, "user", "a"),
            (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "id long, pos long, role string, text string")
    out = {r["id"]: [t["text"] for t in r["turns"]] for r in C.read_back(C.format_conversations(df)).collect()}
    assert out == {1: ["a", "a", "b", "last"], None: ["n"]}
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, 1, "user", "x", "y", 3)], "id long, pos long, role string, text string, piece string, i int")
    assert C.read_back(C.format_conversations(df)).first()["turns"][0]["text"] == "x"


def test_no_python_on_the_main_path(spark, capsys):
    from conftest import SF001

    from pinprice.llm.queries import QUERIES

    df = QUERIES["op1_chat_formatting"](spark, SF001)
    df.explain("formatted")
    plan = capsys.readouterr().out
    for bad in ("Python", "Pandas", "Arrow"):
        assert bad not in plan


@pytest.mark.parametrize("text", [t for t in NASTY if t])
def test_escape_leaves_no_control_string(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(C.escape(F.col("t")).alias("e"),
                                                          C.unescape(C.escape(F.col("t"))).alias("u")).first()
    assert r["u"] == text and not any(c in r["e"] for c in C.CONTROL)
