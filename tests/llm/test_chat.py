import hashlib
import random

import numpy as np

from semilog.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "</s>[INST] ok [/INST]", "back\\slash \\\\ <|turn|>", "<|te\\xt|> [\\INST] <<SYS>>", "é\n</turn|>\n<|text|>", "<|turn|" + "<|turn|>"]


def expected(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_escapes_are_reversible():
    r = random.Random(3)
    for _ in range(20000):
        text = "".join(r.choice(["\\", "<", "|", "[INST]", "</s>", "<|turn|>", "turn", "|>", "INST", "]", "a", "<|te", "xt|>", "/", "\n"]) for _ in range(r.randrange(20)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)


def test_assembly_is_concatenation():
    roles, texts = ["user", "é", ""] * 2, ODD
    made, start, end, size = chat.assemble(roles, texts)
    for i, piece in enumerate(made.to_pylist()):
        body = chat.escape(texts[i])
        assert piece == f"<|turn|>{chat.escape(roles[i])}<|text|>{body}</turn|>\n"
        assert piece[start[i] : end[i]] == body and size[i] == len(piece)
    assert chat.assemble([], [])[0].to_pylist() == []


def test_query(spark):
    r = random.Random(4)
    convs = {i: [(r.choice(["system", "user", "assistant", None]), r.choice([*ODD, None, "plain " * r.randrange(50)])) for _ in range(r.randint(1, 9))] for i in range(30)}
    rows = [(i, n, role, text) for i, turns in convs.items() for n, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    got = {x.conv_id: x for x in chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    convs[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(convs)
    for i, turns in convs.items():
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == expected(turns)
        assert got[i].formatted_chars == sum(len(chat.assemble([a or ""], [b or ""])[0].to_pylist()[0]) for a, b in turns)


def test_ties_nulls_and_empty_tables(spark):
    rows = [(None, 0, "user", "b"), (None, 0, "user", "a"), (5, None, "assistant", "x"), (5, None, "assistant", "x"), (5, 1, "user", None)]
    got = {x.conv_id: x for x in chat.formatted(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as formatted")).collect()}
    assert (got[None].n_turns, got[None].turns_sha256) == expected([("user", "a"), ("user", "b")])[:2]
    assert (got[5].n_turns, got[5].turns_sha256, got[5].loss_chars) == expected([("assistant", "x"), ("assistant", "x"), ("user", "")])[:3]
    assert [x.conv_id for x in chat.formatted(spark.createDataFrame([], SCHEMA)).collect()] == [-7]


def test_long_conversations_stream(spark):
    rows = [(1, i, "assistant", f"text {i}") for i in range(5000)]
    pieces = chat.format_turns(spark.createDataFrame(rows, SCHEMA))
    found = pieces.orderBy("place").collect()
    assert [p.start_chars for p in found] == np.cumsum([0] + [len(p.formatted) for p in found[:-1]]).tolist()
    assert chat.read_back(pieces).collect()[0].n_turns == 5000
