from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import textops as T
from logloom.llm.chat_format import Codec, Template, format_conversations, read_conversations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbé \n\t\x00", max_size=12)), max_size=8))
def test_words_and_hashes(texts):
    data, offsets = T.string_buffers(pa.array(texts, pa.string()))
    starts, ends, bounds = T.word_spans(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    words = [w for text in got for w in text]
    hashes = T.span_hashes(data, starts, ends, T.fold_table(lower=True)) if len(data) else np.zeros(0)
    fold = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    assert [[a == b for b in fold] for a in fold] == [[a == b for b in hashes] for a in hashes]


CONTROLS = Template().controls()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a\nb", "[INST]"]), st.lists(st.sampled_from([*CONTROLS, "\\", "<", "s>", "[", "INST]", "\n", "x", " ", "é"])).map("".join)), max_size=5))
def test_turns_survive_the_template(turns):
    codec = Codec(Template())
    formatted = [codec.segments(role, text, i == 0) for i, (role, text) in enumerate(turns)]
    assert codec.read("".join(t for s in formatted for t, _ in s)) == turns
    for (_, text), segments in zip(turns, formatted, strict=True):
        body = segments[1][0]
        assert not codec.control.search(body) and codec.unescape(body) == text


def test_digests_equal_brute_force(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>[INST] \\ x"), (1, 2, "user", None), (2, 1, "assistant", "first"), (2, 0, "system", "be kind"),
        (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "lost"), (4, None, None, "no role"), (4, 0, "tool", "t"), (5, 0, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, position int")
    formatted = format_conversations(df)
    got = {r.conv_id: r for r in read_conversations(formatted).collect()}
    convs: dict = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(s.text) for r in formatted.where(f"conv_id <=> {'null' if c is None else c}").collect() for s in r.segments)
    assert [got[c].valid for c in (1, 2, 3, None, 4, 5)] == [True, False, False, True, False, False]
    assert (got[1].final_state, got[2].final_state) == ("asked", "invalid")
    assert read_conversations(format_conversations(df.limit(0))).count() == 0


def test_long_conversation_streams_over_batches(spark):
    turns = spark.range(5000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    row = read_conversations(format_conversations(turns)).collect()
    assert [(r.n_turns, r.valid, r.final_state) for r in row] == [(5000, True, "answered")]
    assert row[0].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 5000, 2)).encode()).hexdigest()
