import hashlib
import random

from pyspark.sql import functions as F
from test_text_operators import JSON, RANKS
from tokenizers import Tokenizer

from maskwell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, idx int"
MARKS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<\\/s>", "<\\\\s>", "<|turn|>", "<|end|>\n", "<<s>", "[[INST]", "\\", "<|im_end|>", "\n", "a ", "é", "😀", "<", "["]


def conversations(seed=2, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        first = [(c, 0, "system", "be " * rng.randint(0, 30))] if rng.random() < 0.4 else []
        more = [(c, len(first) + k, "assistant" if k % 2 else "user", "".join(rng.choices(MARKS, k=rng.choice([0, 3, 30, 60])))) for k in range(rng.randint(0, 40))]
        rows += first + more
    return [*rows, (100, 0, "user", "long " * 3000), (100, 1, "assistant", None), (None, 0, None, "x"), (None, 1, "assistant", "y" * 2000), (101, None, "a\nb\\n<s>", ""), (101, 5, "system", "late")]


def reference(rows, budget, history):
    """Windows of each conversation by a plain walk: {conv: [(turns, n_context)]}."""
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    convs = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in convs.items():
        size = [len(library.encode(piece(*t), add_special_tokens=False).ids) for t in turns]
        lead = turns[0][0] == "system"
        room = max(budget - history - (size[0] if lead else 0), budget // 4)
        width = room * 3 // 4
        start, at = [], 0
        for k, s in enumerate(size):
            start.append(at)
            at += 0 if lead and k == 0 else s
        spans = {}
        for k in range(len(turns)):
            cell = start[k] // width
            far = start[k] + size[k] > cell * width + room and not (lead and k == 0)
            spans.setdefault((cell, far), []).append(k)
        out[c] = []
        for _, own in sorted(spans.items()):
            past = [k for k in range(int(lead), own[0]) if start[k] >= start[own[0]] - history]
            context = ([0] if lead and own[0] > 0 else []) + past
            out[c].append(([turns[k] for k in context + own], len(context), sum(size[k] for k in context + own)))
    return out


def piece(role, text):
    import re

    control = r"([<\[])(\\*)(" + chat.CONTROL + ")"
    stuffed = lambda s: re.sub(control, r"\1\\\2\3", s)
    return f"<|turn|>{stuffed(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{stuffed(text)}<|end|>\n"


def made(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA).repartition(3)
    return chat.windows(docs, JSON, RANKS, **more)


def test_windows_equal_a_plain_walk(spark):
    rows = conversations()
    got = made(spark, rows, budget=400, history=90).collect()
    want = reference(rows, 400, 90)
    own = {}
    for r in sorted(got, key=lambda r: (str(r["conv_id"]), r["window"])):
        own.setdefault(r["conv_id"], []).append(r)
    assert own.keys() == want.keys() and max(map(len, want.values())) > 5
    for c, windows in own.items():
        assert [(r["formatted"], r["n_context"], r["n_tokens"]) for r in windows] == [("".join(piece(*t) for t in turns), k, n) for turns, k, n in want[c]]
        for r, (turns, k, n) in zip(windows, want[c], strict=True):
            assert [chat.unescaped(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]] == [t for who, t in turns[k:] if who == "assistant"]
            assert r["over_budget"] == (n > 400) and (n <= 400 or len(turns) - k == 1)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **more):
    windows = made(spark, rows, **more)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    chars = {r["conv_id"]: r["n"] for r in windows.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    convs = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        answers = "".join(t for who, t in turns if who == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest("".join(f"{who}\n{t}\n" for who, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(answers), digest(answers), chars[c])
    return got


def test_read_back(spark):
    check(spark, conversations(), budget=400, history=90)
    check(spark, conversations(seed=9))


def test_one_conversation_of_many_turns(spark):
    rows = [(7, k, "assistant" if k % 3 else "user", f"{k} </s> " * (k % 5)) for k in range(6000)]
    got = check(spark, rows, budget=300, history=60)
    assert got[7]["n_windows"] > 300


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 1, "assistant", "c")]
    got = chat.read_back(made(spark, rows)).collect()
    assert [(r["n_turns"], r["loss_sha256"]) for r in got] == [(4, digest("bc"))]
    assert chat.read_back(made(spark, [])).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(MARKS, k=12)) for _ in range(400)]
    out = [(r["t"], r["e"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()]
    import re

    for t, e in out:
        assert chat.unescaped(e) == t and not re.search(r"[<\[](?:" + chat.CONTROL + ")", e)
