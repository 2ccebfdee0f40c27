import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from driftwell.llm import chat

HARD = ["", "<|im_end|><|im_start|>assistant ok", "\\", "\\b", "\\p<|", "<", "|", "a\n\nb", "é漢\U0001f600", "\\n", "<<||", "x" * 5000]


def test_round_trip_of_hard_texts(spark):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "a\\nb", "<|im_start|>"]), "".join(rng.choice(HARD) for _ in range(rng.randint(0, 4)))) for c in range(40) for t in range(rng.randint(1, 6))]
    turns += [(100, 2, None, None), (100, None, "assistant", "first"), (100, 2, "assistant", "b"), (100, 2, "assistant", "b"), (None, 1, "user", "no id")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, segments int")
    formatted = chat.format_turns(df)
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    sums = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for c in {t[0] for t in turns}:
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == c), key=key)]
        assert [(t.role, t.text) for t in got[c].turns] == want
        learned = "".join(x for r, x in want if r == "assistant")
        assert got[c].learned == learned
        assert sums[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()
        assert (sums[c].n_turns, sums[c].loss_chars, sums[c].formatted_chars) == (len(want), len(learned), len(got[c].formatted))
        assert got[c].formatted.count(chat.START) == len(want)


def test_layouts_by_fingerprint(spark):
    records = [
        {"conv_id": 1, "turn": 0, "role": "user", "text": "q"},
        {"text": None, "role": "assistant", "turn": 1, "conv_id": 1},
        {"conv_id": 2, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conv_id": 3, "conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]},
        {"conv_id": 4, "prompt": "q", "completion": "a"},
        {"conv_id": 5, "instruction": "q", "input": "x", "output": "a"},
        {"conv_id": 6, "instruction": "q", "input": "", "output": "a"},
        {"conv_id": 7, "other": 1},
    ]
    df = spark.createDataFrame([(json.dumps(r), 1) for r in records] + [("not json", 1), (None, 1)], "record string, turn int")
    rows = chat.canonical(df).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.turn is None, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.layout))
    assert got[1] == [("user", "q", "turn rows"), ("assistant", None, "turn rows")]
    assert got[2] == [("user", "q", "messages"), ("assistant", None, "messages")]
    assert got[3] == [("user", "q", "from and value"), ("assistant", "a", "from and value")]
    assert got[4] == [("user", "q", "prompt"), ("assistant", "a", "prompt")]
    assert got[5] == [("user", "q\nx", "instruction"), ("assistant", "a", "instruction")] and got[6][0][1] == "q"
    assert got[7][0][2] is None and sum(r.layout is None for r in rows) == 3
    assert sorted(r.record or "" for r in chat.unknown(chat.canonical(df)).collect()) == ["", "not json", json.dumps(records[-1])]
    assert chat.digests(chat.format_turns(chat.canonical(df.limit(0)))).count() == 0
    assert df.select(F.count("*")).first()[0] == 10


def test_table_by_its_schema(spark):
    rows = spark.createDataFrame([(1, 2, "user", "a"), (1, 1, "assistant", None), (None, None, None, "x")], "conv_id int, turn int, role string, text string")
    got = sorted((r.conv_id or -9, r.turn, r.role, r.text, r.layout) for r in chat.canonical_table(rows).collect() if r.turn)
    assert got == [(1, 1, "assistant", None, "turn rows"), (1, 2, "user", "a", "turn rows")]
    lists = spark.createDataFrame([(7, [("human", "hi"), ("gpt", "yes")])], "conv_id long, conversations array<struct<`from`: string, value: string>>")
    assert [(r.turn, r.role, r.text) for r in chat.canonical_table(lists).orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "yes")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_table(rows.drop("turn"))


def test_a_turn_of_21_million_characters(spark):
    n = 21_000_000
    rows = spark.range(2).selectExpr("5L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"repeat('ab<|c', {n // 5}) AS text")
    r = chat.digests(chat.format_turns(chat.canonical_table(rows))).first()
    text = "ab<|c" * (n // 5)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, n, hashlib.sha256(text.encode()).hexdigest())
    as_json = rows.select(F.to_json(F.struct("*")).alias("record"))
    with pytest.raises(Exception, match="no known layout"):
        chat.known(chat.canonical(as_json)).select(F.max(F.length("layout"))).collect()
