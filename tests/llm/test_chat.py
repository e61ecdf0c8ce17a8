import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from nuntia.llm import chat

MARKS = st.text(alphabet=st.sampled_from(list("\\#<>:/ a\né🎉")) | st.characters(codec="utf-8"), max_size=40)


def packed(strings):
    raw = [s.encode() for s in strings]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


@given(st.lists(st.tuples(MARKS, MARKS), max_size=6))
def test_every_conversation_is_read_back_exactly(turns):
    out, starts, begin, end = chat.assemble(packed([r for r, _ in turns]), packed([t for _, t in turns]))
    assert chat.read_turns(out.tobytes()) == [(r.encode(), t.encode()) for r, t in turns]
    # no text or role imitates a mark
    assert out.tobytes().count(chat.HEAD) == out.tobytes().count(chat.END) == len(turns)
    for (_, text), a, b in zip(turns, begin, end, strict=True):
        own = out[a:b]
        assert own[~chat.escapers(own)].tobytes() == text.encode()


def expected(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("part_bytes", [1 << 20, 7])
def test_digests_follow_the_turns(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    rows = [
        (1, 0, "user", "hé"), (1, 1, "assistant", "### user: x </turn>\n"), (1, 2, None, None), (1, 2, "assistant", "\\"), (2, 5, "assistant", ""), (2, None, "user", "first"), (None, 0, "user", "no id"),
        (3, 0, "as:sist\nant", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, 0, "assistant", "long " * 50_000),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, turns int")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_digest(chat.format_chat(df)).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r, x))
    assert got == {c: expected(v) for c, v in by.items()}


def test_parts_join_to_one_text_and_masks_cover_the_assistant(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"é{i}" * 300_000) for i in range(4)], "conv_id int, turn int, role string, text string")
    parts = chat.format_chat(df).orderBy("part").collect()
    assert len(parts) == 4 and [p["part"] for p in parts] == [0, 1, 2, 3] and sum(p["turns"] for p in parts) == 4
    for p in parts:
        for a, b in zip(p["loss_starts"], p["loss_ends"], strict=True):
            assert p["content"][a:b].startswith("é") and p["content"][b:] == " </turn>\n"
    assert [len(p["loss_starts"]) for p in parts] == [0, 1, 0, 1]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(chat.format_chat(df)).collect() == []


def test_query(spark, sf_dir):
    df = chat.op1_chat(spark, sf_dir)
    assert df.dtypes == [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")]
    rows = {r["conv_id"]: r for r in df.collect()}
    assert tuple(rows[-7])[1:5] == expected([("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")])
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect()
    by = {}
    for r in talk:
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert len(rows) == len(by) + 1 and all(tuple(rows[c])[1:5] == expected(v) for c, v in by.items())
