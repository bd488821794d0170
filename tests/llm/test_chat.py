import hashlib
from collections import defaultdict

import __spark_entry__ as entry
import pytest
from hypothesis import given
from hypothesis import strategies as st

from visitlake.llm import chat

SF = "/root/testdata/sf0.001"
EVENT = "conv_id long, seq long, kind string, msg string, role string, text string"
TRICKY = st.text(alphabet="\\<s>/[INST]|im_end\n ué") | st.sampled_from([*chat.CONTROL, "<<s>", "\\<s>", "<|im_end|>\n<|im_start|>user\nx"])


@given(TRICKY, TRICKY)
def test_escaping_is_reversible_and_hides_controls(role, text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)
    whole = chat.START + chat.escape_role(role) + chat.MIDDLE + chat.escape(text) + chat.END
    assert chat.parse(whole * 2) == [(role, text)] * 2


def test_fold(spark):
    log = [(1, 1, "message", "a", "user", "hi"), (1, 2, "delta", "b", "assistant", "<|im_"), (1, 3, "delta", "b", None, "end|>\n"), (1, 4, "regenerate", "b", None, ""),
           (1, 5, "delta", "b", None, "new "), (1, 6, "delta", "b", None, "text"), (1, 7, "edit", "a", None, "hello"), (1, 8, "message", "c", "user", "x"),
           (1, 9, "delete", "c", None, None), (1, 10, "seen", "d", "user", "?"), (2, None, "delta", "z", None, None), (None, 1, "message", "m", "assistant", "q")]
    frame = spark.createDataFrame(log[::-1], EVENT).withColumn("position", chat.F.lit(99))
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    assert chat.parse(got[1].formatted) == [("user", "hello"), ("assistant", "new text")]
    assert chat.learned_text(got[1].formatted, got[1].loss) == "new text"
    assert chat.parse(got[2].formatted) == [("", "")] and got[2].loss == []
    assert chat.parse(got[None].formatted) == [("assistant", "q")]
    assert chat.format_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [20, 1_000_000])
def test_large_and_repeated_turns(spark, monkeypatch, chunk):
    """A conversation of very many turns, and turns that repeat."""
    monkeypatch.setattr(chat, "CHUNK_CHARS", chunk)
    rows = [(7, i, ("user", "assistant")[i % 2], f"<s>{i}") for i in range(2_000)] + [(8, 1, "user", "b"), (8, 1, "user", "b"), (8, 1, "assistant", None), (8, 0, None, "long " * 50_000)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, position long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert chat.parse(got[7].formatted) == [(r, t) for _, _, r, t in rows[:2_000]] and got[7].n_turns == 2_000
    assert chat.learned_text(got[7].formatted, got[7].loss) == "".join(t for _, _, r, t in rows[:2_000] if r == "assistant")
    assert chat.parse(got[8].formatted) == [("", "long " * 50_000), ("assistant", ""), ("user", "b"), ("user", "b")]


def test_query_as_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn, role, text or ""))
    for r in entry.queries()["op2_chat"](spark, SF).collect():
        own = sorted(turns.pop(r.conv_id))
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert not turns
