import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from veilgauge.llm import chat
from veilgauge.llm.queries import EXTRA_CONVERSATION, QUERIES

ROWS = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|>s/[INST]\\ \nSYim_startend", max_size=60) | st.sampled_from(chat.CONTROLS) | st.text(max_size=20))
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = [t or "" for _, _, role, t in own if role == "assistant"]
        out[conv] = (len(own), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    return out


AWKWARD = [(1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 3, "assistant", "a\\b <|im_end|>\n</s>"), (2, 0, None, "no role"), (2, 1, "tool\nname", "x"),
           (3, 5, "assistant", "é" * 50_000), (3, 2, "system", "<|image|> [INST] é "), (None, 0, "assistant", "lost"), (None, 1, "user", "found")]


def test_digests_read_back_equal_a_plain_reading(spark):
    got = chat.read_back(chat.format_turns(spark.createDataFrame(AWKWARD, ROWS))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(AWKWARD)


def test_query_adds_the_stated_conversation(spark, tmp_path):
    rows = [r for r in AWKWARD if r[0] is not None]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op5_chat"](spark, str(tmp_path)).collect()
    both = [(-7, 0, "user", EXTRA_CONVERSATION), (-7, 1, "assistant", EXTRA_CONVERSATION)]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(rows + both)
    formatted = chat.conversations(chat.format_turns(spark.createDataFrame(both, ROWS))).collect()
    assert sum(len(r.segment) for r in formatted) == next(r.formatted_chars for r in got if r.conv_id == -7)
    assert not any(c in "".join(r.segment for r in formatted).replace(chat.OPEN, "").replace(chat.CLOSE, "") for c in ("</s>", "[INST]", "[/INST]"))


def test_parts_become_ordered_placeholders_with_references_and_tokens(spark):
    part = "type string, text string, ref string, width int, height int, seconds double, pages int"
    rows = [(1, 0, "assistant", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 1000, 500, None, None), ("text", "", None, None, None, None, None),
                                 ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 3), ("image", None, None, None, None, None, None), (None, "end", None, None, None, None, None)]),
            (1, 1, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<struct<{part.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>")
    first, second = chat.format_turns(df, text=None, parts="content").orderBy("turn").collect()
    assert first.segment == "<|im_start|>assistant\nsee <\\|image|\\><|image|><|audio|><|document|><|image|>end<|im_end|>\n"
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "i.png", 85 + 2 * 170), (1, "audio", "a.wav", 63), (2, "document", "d.pdf", 2400), (3, "image", None, 85)]
    assert first.expanded_tokens == 425 + 63 + 2400 + 85
    assert "".join(chat.unescape(first.segment[s.first:s.past]) for s in first.loss_spans) == "see <|image|>end"
    assert second.segment == "<|im_start|>user\n<|im_end|>\n" and second.attachments == []


def test_unknown_parts_and_broken_output_are_errors(spark):
    with pytest.raises(ValueError):
        chat.PartVisitor().visit({"type": "video"})
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\nhalf")


def test_ties_repeated_rows_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "b", "own"), (1, 0, "assistant", "a", "own"), (1, 0, "assistant", "a", "own")], ROWS + ", Segment string")
    formatted = chat.format_turns(df)
    assert [c for c in formatted.columns if c.lower() == "segment"] == ["segment"]
    got = chat.read_back(formatted).first()
    assert got.n_turns == 3 and got.loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
