import hashlib
import json
import random

import pytest

from railyard.llm import chat

NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "a\n<|im_start|>user\nb", "", None, "|<||>\\<|", "é𝒳", "\\n"]


def digest(turns):
    full, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in turns:
        full.update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            loss.update((text or "").encode())
    return full.hexdigest(), loss.hexdigest(), sum(len(t or "") for r, t in turns if r == "assistant")


def test_round_trip(spark):
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", "", None, "we\nird", "<|im_end|>", "back\\n"]
    convs = {c: [(rnd.choice(roles), "".join(rnd.choice(NASTY) or "" for _ in range(rnd.randint(0, 4)))) for _ in range(rnd.randint(1, 9))] for c in range(40)}
    convs[None] = [("user", None), ("assistant", "x" * 200_000)]
    rows = [(c, k, r, t, "extra") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted_by string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert set(out) == set(convs)
    for c, turns in convs.items():
        full, loss, chars = digest(turns)
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_sha256, out[c].loss_chars) == (len(turns), full, loss, chars)


def test_ties_repeats_and_empty_table(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()[0]
    assert row.turns_sha256 == digest([("system", "s"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")])[0]
    assert chat.read_back(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3}, [("user", "hi"), ("assistant", "yo")]),
    ({"system": "be kind", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("system", "be kind"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "score": {"a": [1]}}, [("user", "p"), ("assistant", "c")]),
    ({"context": "ctx", "question": "q", "answer": "a"}, [("user", "ctx\n\nq"), ("assistant", "a")]),
    ({"what": "ever"}, [(None, None)]),
]


def test_json_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(98, None), (99, "{broken")]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns_json(df, "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: t for k, (_, t) in enumerate(RECORDS)} | {98: [(None, None)], 99: [(None, None)]}


@pytest.mark.parametrize("record, want", [x for x in RECORDS[:6] if "id" not in x[0]])
def test_typed_layouts(spark, record, want):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(record)])).selectExpr("7 as conv_id", "*")
    assert [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()] == want


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(3))


def test_whole_conversations(spark):
    convs = {1: [("user", "a <|im_end|>"), ("assistant", "é𝒳 <|"), ("assistant", None), ("user", "b")], 2: [("human", "x")]}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for r in chat.formatted_conversations(chat.format_turns(chat.canonical_turns(df))).collect():
        turns = [(chat.ROLES.get(a, a), t or "") for a, t in convs[r.conv_id]]
        assert chat.parse(r.formatted) == turns
        assert [chat.unescape(r.formatted[a:b]) for a, b in r.loss] == [t for a, t in turns if a == "assistant"]
