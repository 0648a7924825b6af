import hashlib
import random
from collections import defaultdict

import pytest

from quillspark.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "\\", "\\\\<\\|", "<", "a<", "<<SYS>>", "[/INST]", "\n\n", "", None, "é😀\u0000", "$1 \\n \\<|", "<s> </s>", "x" * 20000]


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd role\n<|im_end|>", None]), rng.choice(NASTY), "y") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "assistant", "lost", "y"), (None, 1, None, None, "y"), (3, 0, "user", "tie", "y"), (3, 0, "user", "tie", "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(chat.canonical_turns(df))
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(formatted)).collect()}
    whole = {r["conv_id"]: r for r in formatted.collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        text = whole[c]["formatted"]
        assert got[c]["formatted_chars"] == len(text)
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns) and "</s>" not in text and "[INST]" not in text
    assert chat.digests(chat.read_back(chat.format_chats(chat.canonical_turns(df.limit(0))))).count() == 0


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 1 AS conv_id, 'p' AS prompt, 'r' AS response", [("user", "p"), ("assistant", "r")]),
        ("SELECT 1 AS conv_id, 'i' AS instruction, 'x' AS input, 'o' AS output, 9 AS extra", [("user", "i\n\nx"), ("assistant", "o")]),
        ("SELECT 1 AS conv_id, 'i' AS instruction, null AS input, 'o' AS output", [("user", "i"), ("assistant", "o")]),
        ("SELECT 1 AS conv_id, null AS system, 'i' AS instruction, '' AS input, null AS output", [("user", "i"), ("assistant", "")]),
        ("SELECT 1 AS conv_id, 's' AS system, 'p' AS prompt, 'r' AS response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ("SELECT 1 AS conv_id, array(named_struct('role', 'user', 'content', 'q', 'name', 'n'), null, named_struct('role', 'assistant', 'content', null, 'name', 'n')) AS messages", [("user", "q"), ("assistant", "")]),
        ("SELECT 1 AS conv_id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) AS conversations", [("user", "q"), ("assistant", "a")]),
    ],
)
def test_layouts(spark, sql, want):
    rows = chat.canonical_turns(spark.sql(sql)).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in rows] == want


def test_unknown_layout(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.sql("SELECT 1 AS conv_id, 'a' AS foo"))


def test_plan_is_native(spark):
    df = spark.range(5).selectExpr("id % 3 AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    plan = chat.digests(chat.read_back(chat.format_chats(chat.canonical_turns(df))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
