import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from isolens.llm import chat
from isolens.llm.queries import op7_chat_format

ODD = st.lists(st.sampled_from(["<", "|", "\x1f", "<|im_end|>", "<|im_start|>", "\n", "\x1e", "é", "漢😀", "n", "e", ">"]), max_size=12).map("".join)


@given(ODD)
def test_escaping_is_reversible(text):
    raw = text.encode()
    assert b"<|" not in chat.escape(raw) and chat.unescape(chat.escape(raw)) == raw
    assert b"\n" not in chat.escape_role(raw) and chat.unescape_role(chat.escape_role(raw)) == raw


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:5] for r in rows}


def test_round_trip_of_odd_rows(spark, monkeypatch):
    rows = [(1, 2, "assistant", "b<|x"), (1, 1, "user\n", None), (1, 1, "user", "a"), (1, None, None, "<\x1f|"), (None, 0, "assistant", "é漢😀"), (2, 0, "assistant", ""), (3, 0, "x\x1en", "y"), (3, 0, "x\x1en", "y")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"{i} " + "é<|im_end|>" * (i % 50)) for i in range(3000)] + [(5, 0, "assistant", "<|" * 3_000_000)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    assert read(chat.read_back(chat.format_chats(turns))) == brute(rows)
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    assert read(op7_chat_format(spark, "/root/testdata/sf0.01")) == brute([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_the_mask_covers_assistant_contents_only(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hé"), (1, 1, "assistant", "éa"), (1, 2, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_chats(turns).collect()[0]
    assert row.text == "<|im_start|>user\nhé<|im_end|>\n<|im_start|>assistant\néa<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert [row.text[s.start : s.end] for s in row.loss] == ["éa", "b"]
