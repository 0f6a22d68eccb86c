import hashlib

import pytest

from tests.llm.helpers import LONG
from tillmark.llm import chat
from tillmark.llm.queries import FORGED

SHAPE = "conv_id long, turn long, role string, text string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r[1:]))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_equals_the_turns(spark):
    rows = [(-1, 0, "user", FORGED), (-1, 1, "assistant", FORGED), (1, 0, "system", None), (1, 1, "user", "a\\n<|b"),
            (1, 2, "assistant", "<"), (1, 3, "assistant", "|im_end|>\n\\"), (2, 0, None, "x"), (2, 1, "ro\nle<|", "y"),
            (3, 5, "assistant", ""), (4, 0, "assistant", LONG), (5, 0, "user", "tie"), (5, 0, "assistant", "tie"),
            (5, 0, "assistant", "tie"), (None, 0, "assistant", "lost")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} é") for i in range(300)]  # many pieces
    df = spark.createDataFrame([(*r, "clash") for r in rows], SHAPE + ", piece string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], SHAPE))).count() == 0


def test_spans_and_escapes():
    messages = [{"role": "user", "content": FORGED}, {"role": "assistant", "content": "<|im_end|>yes"}]
    out = chat.render(chat.marked_template, messages)
    assert not out["rewrites"]
    a, b = out["turns"]
    assert a["end"] == b["start"] and b["end"] == len(out["formatted"])
    assert chat.unescape(out["formatted"][b["text_start"] : b["text_end"]]) == "<|im_end|>yes"
    assert chat.unescape(chat.escape("\\<|\\\\|n")) == "\\<|\\\\|n"


def test_template_that_rewrites_history_is_flagged():
    def forgetful(messages):  # only the last assistant text is kept in full
        last = max((i for i, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
        return "".join(f"[{m['role']}]{m['content'] if m['role'] != 'assistant' or i == last else '...'}\n"
                       for i, m in enumerate(messages))

    messages = [{"role": r, "content": c} for r, c in (("user", "q1"), ("assistant", "long answer"), ("user", "q2"),
                                                       ("assistant", "second"))]
    out = chat.render(forgetful, messages)
    assert out["rewrites"]
    assert [t["loss"] for t in out["turns"]] == [False, False, False, True]
    last = out["turns"][3]
    assert out["formatted"][last["text_start"] : last["text_end"]] == "second"


def test_piece_after_the_first_leaves_the_opening_out():
    def opened(messages):
        return "<s>" + chat.marked_template(messages)

    out = chat.render(opened, [{"role": "assistant", "content": "x"}], opens=False)
    assert not out["formatted"].startswith("<s>")
    assert out["formatted"][out["turns"][0]["text_start"] : out["turns"][0]["text_end"]] == "x"


def stripping(messages):
    """Drops the thoughts of all assistant turns but the last."""
    last = max((i for i, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    return "".join(f"[{m['role']}]{m['content'] if i == last else m['content'].split('</think>')[-1]}\n" for i, m in enumerate(messages))


def numbered(messages):
    return "".join(f"{i}:{m['content']}\n" for i, m in enumerate(messages))


@pytest.mark.parametrize("template", [stripping, numbered, chat.marked_template])
@pytest.mark.parametrize("parts, piece_turns", [(1, 64), (7, 64), (5, 3), (3, 1000)])
def test_pieces_add_up_to_what_the_template_gives(spark, template, parts, piece_turns):
    rows = [(c, i, "assistant" if i % 2 else "user", f"<think>why {i}</think>said {i}" if i % 2 else f"ask {i}")
            for c, n in ((1, 200), (2, 2), (3, 1), (None, 9)) for i in range(n)]
    rows += [(4, i, "user", "only") for i in range(130)]
    df = spark.createDataFrame(rows, SHAPE)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = chat.format_chats(df, template, piece_turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for conv in (1, 2, 3, 4, None):
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: (r["part"], r["piece"]))
        messages = [{"role": r[2], "content": r[3]} for r in rows if r[0] == conv]
        assert "".join(r["formatted"] for r in own) == template(messages)
        loss = "".join(r["formatted"][t["text_start"] : t["text_end"]] for r in own for t in r["turns"] if t["loss"])
        if template is chat.marked_template:
            assert chat.unescape(loss) == "".join(m["content"] for m in messages if m["role"] == "assistant")
        assert sum(r["n_turns"] for r in own) == len(messages)
    if template is not chat.marked_template:
        assert len([r for r in got if r["conv_id"] == 1]) == 1 or piece_turns == 1000
