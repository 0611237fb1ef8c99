import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from regspark.llm import chat_format as C
from tests_data import rows


@given(st.text(alphabet="<|>\\s/[]INSTYturnexdb_ 🙂", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in C.CONTROL)


def expected(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_reads_back_all_turns(spark):
    by = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for conv, _, role, text in sorted(rows("sf0.001", "conversations", "conv_id, turn, role, coalesce(text, '')")):
        by.setdefault(conv, []).append((role, text))
    assert read(C.query(spark, "/root/testdata/sf0.001")) == {c: expected(t) for c, t in by.items()}


def test_windows_keep_the_budget_and_learn_each_answer_once(spark):
    turns = [(5, 0, "system", "be kind")] + [(5, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * (i % 17)) for i in range(1, 200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = C.format_chats(df, budget=60, history=20)
    got = windows.collect()
    assert len(got) > 5 and all(w.n_tokens <= 60 or w.n_new == 1 for w in got)
    assert all(C.parse(w.text)[0][0] == "system" for w in got) and any(w.n_repeated > 1 for w in got)
    assert read(C.read_back(C.format_chats(df, budget=60, history=20)))[5] == expected([(r, t) for _, _, r, t in turns])


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, 0, None, None), (None, 0, "user", "a"), (2, None, "user", "x" * 10_000), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")], "conv_id long, turn long, role string, text string")
    got = read(C.read_back(C.format_chats(df)))
    assert got[1] == expected([("", "")]) and got[2] == expected([("user", "x" * 10_000), ("assistant", "same"), ("assistant", "same")]) and None in got
    assert C.read_back(C.format_chats(df.limit(0))).count() == 0
