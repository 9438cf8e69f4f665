import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from deckloom.llm import chat

TEXT = st.lists(
    st.sampled_from(["\\", "<", "</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_sep|>", "a", "\n", "é", "<<SYS>>", "$0", " "]), max_size=8
).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd\\<s>"]), TEXT), max_size=6))
def test_round_trip(spark, turns):
    rows = spark.createDataFrame([(1, [{"role": r, "text": t} for r, t in turns])], f"conv_id long, turns {chat.TURNS}")
    row = chat.read_back(chat.format_chat(rows)).first()
    assert [(t["role"], t["text"]) for t in row["turns_read"]] == turns
    assert row["loss_read"] == "".join(t for r, t in turns if r == "assistant")
    body = row["formatted"]
    assert body.count("<|im_end|>") == len(turns) and "</s>" not in body and "[INST]" not in body


def test_layouts_give_the_same_turns(spark):
    q, a = "What?", "This."
    tables = {
        "messages": [{"id": 1, "messages": [{"role": "user", "content": q}, {"role": "assistant", "content": a}], "extra": 1}],
        "speaker_value": [{"id": 1, "conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}]}],
        "prompt_response": [{"id": 1, "prompt": q, "response": a}],
        "instruction_output": [{"id": 1, "instruction": q, "input": "", "output": a}],
        "question_answer": [{"id": 1, "question": q, "answer": a}],
        "rows_by_turn": [{"id": 1, "turn": 1, "role": "assistant", "text": a}, {"id": 1, "turn": 0, "role": "user", "text": q}],
    }
    for layout, rows in tables.items():
        frame = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
        got = chat.canonical_turns(frame, "id").collect()
        assert [(r["conv_id"], r["layout"], [tuple(t) for t in r["turns"]]) for r in got] == [(1, layout, [("user", q), ("assistant", a)])]


def test_one_table_of_many_layouts(spark):
    rows = ['{"id":1,"prompt":"p","response":"r"}', '{"id":2,"question":"q","answer":null}', '{"id":3,"instruction":"i","input":"x","output":"o"}',
            '{"id":4,"other":5}', '{"id":5,"question":"q","answer":"a","system":"s"}']
    got = {r["conv_id"]: r for r in chat.canonical_turns(spark.read.json(spark.sparkContext.parallelize(rows)), "id").collect()}
    assert [got[i]["layout"] for i in range(1, 6)] == ["prompt_response", None, "instruction_output", None, "question_answer"]
    assert got[3]["turns"][0]["text"] == "i\n\nx" and got[4]["turns"] == [] and got[5]["turns"][0]["role"] == "system"


def test_odd_rows(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, 1, "assistant", "")]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_chat(chat.canonical_turns(table, "conv_id")))).collect()}
    said = "user\nb\n\n\nassistant\nx\nassistant\nx\n"
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 and got[None]["loss_chars"] == 0
    assert chat.format_chat(chat.canonical_turns(table.limit(0), "conv_id")).count() == 0
    very_long = spark.createDataFrame([(1, 0, "assistant", "</s>é" * 200_000)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.read_back(chat.format_chat(chat.canonical_turns(very_long, "conv_id")))).first()["loss_chars"] == 1_000_000


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    from deckloom.llm.queries import op2_chat

    op2_chat(spark, sf_dir).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))


def test_rows_of_two_layouts_keep_their_content(spark):
    rows = ['{"id":1,"prompt":"p","response":"r","completion":"c"}', '{"id":2,"prompt":"p","completion":"c"}', '{"id":3,"prompt":"p"}']
    got = {r["conv_id"]: r for r in chat.canonical_turns(spark.read.json(spark.sparkContext.parallelize(rows)), "id").collect()}
    assert got[1]["layout"] == "prompt_response+prompt_completion"
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "p"), ("assistant", "r"), ("user", "p"), ("assistant", "c")]
    assert got[2]["layout"] == "prompt_completion" and got[3]["layout"] is None and got[3]["turns"] == []


def test_tables_select_rows_by_turn_by_their_print(spark):
    both = spark.createDataFrame([(1, 0, "user", "x", "p", "r")], "id long, turn int, role string, text string, prompt string, response string")
    assert chat.canonical_turns(both, "id").first()["layout"] == "prompt_response"
    assert chat.canonical_turns(both.drop("prompt"), "id").first()["layout"] == "rows_by_turn"
    assert chat.canonical_turns(both.drop("prompt", "text"), "id").first()["layout"] is None
