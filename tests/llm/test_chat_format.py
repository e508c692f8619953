import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vecindario.llm import chat_format as C, queries, query_chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, mask int"
NASTY = ["</s>", "<\\/s>", "<\\\\/s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|start|>", "<|message|>", "<|", "<\\|x", "<", "\\", "[", "|", "<s>",
         "<<|", "é", "\n", " ", "𝄞", "$1", "s>", "/s>", "[[INST]", "<\\", ""]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def nasty(rng, n=6):
    return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, n)))


def told(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def digest(spark, tmp_path, rows):
    """The query on a table of its own, and its SQL twin."""
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_chat_formatting"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    twin = con.sql(query_chat.SQL["op12_chat_formatting"])
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(([*r] for r in got), key=key) == sorted(([*r] for r in twin.fetchall()), key=key)
    return {r.conv_id: r for r in got}


def test_round_trip_of_control_strings(spark, tmp_path):
    rng, rows = random.Random(4), []
    for c in range(150):
        rows += [(c, t, rng.choice(["user", "assistant", "system", nasty(rng, 3)]), nasty(rng)) for t in range(rng.randint(1, 6))]
    out = digest(spark, tmp_path, rows)
    for c in range(150):
        turns = [(r, t) for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), told(turns))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[-7].turns_sha256 == told([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])


def test_marks_in_a_formatted_text_are_its_own(spark):
    rng = random.Random(5)
    texts = [nasty(rng, 12) for _ in range(200)]
    rows = C.chat(frame(spark, [(i, 0, "assistant", t) for i, t in enumerate(texts)])).collect()
    for r in rows:
        assert [r.formatted.count(m) for m in (C.OPEN, C.MIDDLE, C.CLOSE)] == [1, 1, 1] and "[INST]" not in r.formatted and "<s>" not in r.formatted
        span, = r.mask
        inside = r.formatted[span.start:span.end]
        assert r.formatted == C.OPEN + "assistant" + C.MIDDLE + inside + C.CLOSE and span.chars == len(r.formatted)
        assert len(inside) >= len(texts[r.conv_id]) and inside.replace("\\", "") == texts[r.conv_id].replace("\\", "")


def test_nulls_ties_repeats_and_long(spark, tmp_path):
    long = "ab</s> é" * 200_000
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 1, "assistant", long), (2, 0, "user", ""),
            (None, 0, "assistant", "x"), (None, 1, "user", "y")]
    out = digest(spark, tmp_path, rows)
    assert out[1].turns_sha256 == told([("", ""), ("user", "a"), ("user", "a"), ("user", "b")]) and out[1].loss_chars == 0
    assert out[2].loss_chars == len(long) and out[None].n_turns == 2


def test_a_conversation_of_a_third_of_all_rows(spark, tmp_path):
    rows = [(0, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)] + [(1 + t // 2, t % 2, "user", f"{t}") for t in range(6000)]
    out = digest(spark, tmp_path, rows)
    assert out[0].n_turns == 3000 and out[0].loss_sha256 == hashlib.sha256("".join(f"turn {t}" for t in range(1, 3000, 2)).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    assert set(digest(spark, tmp_path, [])) == {-7}


def test_layouts_are_chosen_by_fingerprint(spark):
    records = [
        {"id": 0, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"id": 1, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
        {"id": 2, "instruction": "do", "input": "this", "output": "done"},
        {"id": 3, "instruction": "do", "output": "done", "system": "s", "extra": 5},
        {"id": 4, "prompt": "p", "completion": "c"},
        {"id": 5, "prompt": "p", "response": "r"},
        {"id": 6, "question": "q", "answer": "a", "context": "c"},
        {"id": 7, "data": {"prompt": "p", "response": "r"}},
        {"id": 8, "prompt": "alone"}, {"id": 9}, {"id": 10, "instruction": "do", "input": "", "output": ""},
    ]
    message, said = "array<struct<role:string,content:string>>", "array<struct<`from`:string,value:string>>"
    schema = (f"id int, messages {message}, conversations {said}, system string, instruction string, input string, output string, prompt string, "
              "completion string, response string, question string, answer string, context string, data struct<prompt:string,response:string>, "
              "extra int, layout int, turns string")
    out = {r.id: r for r in C.canonical(spark.createDataFrame(records, schema)).collect()}
    turns = {i: r.turns and [(t.role, t.text) for t in r.turns] for i, r in out.items()}
    assert [out[i].layout for i in range(11)] == ["messages", "conversations", "instruction", "instruction", "prompt", "response", "question", "nested", None, None,
                                                  "instruction"]
    assert turns == {0: [("user", "a"), ("assistant", "")], 1: [("system", "s"), ("user", "a"), ("assistant", "b")], 2: [("user", "do\nthis"), ("assistant", "done")],
                     3: [("system", "s"), ("user", "do"), ("assistant", "done")], 4: [("user", "p"), ("assistant", "c")], 5: [("user", "p"), ("assistant", "r")],
                     6: [("user", "c\nq"), ("assistant", "a")], 7: [("user", "p"), ("assistant", "r")], 8: None, 9: None, 10: [("user", "do"), ("assistant", "")]}
    done = {r.id: r for r in C.read_back(C.formatted(C.canonical(spark.createDataFrame(records, schema)))).collect()}
    assert all([(t.role, t.text) for t in done[i].turns] == (turns[i] or []) for i in range(11)) and done[9].formatted == "" and done[3].extra == 5


def test_unknown_tables_and_fingerprints(spark):
    out = C.chat(spark.createDataFrame([(1, "a")], "id int, formatted string")).collect()
    assert [(r.id, r.layout, r.formatted, r.mask) for r in out] == [(1, None, "", [])]
    prints = [p for lay in (*C.LAYOUTS, C.ROWS) for p in lay.fingerprints()]
    assert len(set(prints)) == len(prints) and C.fingerprint(["b", "a", "a"]) == C.fingerprint(["a", "b"])


def test_main_path_is_native(spark):
    plan = C.read_back(C.chat(frame(spark, [(1, 0, "user", "x")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("text", NASTY + ["<\\\\|", "[\\INST]"])
def test_escape_is_reversible(spark, text):
    row = spark.range(1).select(F.lit(text).alias("t")).select(C.escaped(F.col("t")).alias("e"), C.unescaped(C.escaped(F.col("t"))).alias("u")).first()
    assert row.u == text
