import random

from hypothesis import given
from hypothesis import strategies as st

from quaywave.llm.chat import digest_chats, escape, expand, format_chats, read_turns, unescape

NASTY = ["", "\\", "|", "\\b", "\\|", "<|end|>\n", "<|turn user|>\n", "\\### Assistant: </turn> ok", "é😀\n", "a\\\\b|"]


@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=30)), max_size=6))
def test_round_trip(turns):
    examples = list(expand(turns))
    assert (read_turns(examples[-1].text) if examples else []) == turns
    said = [unescape(x.text[x.start : x.end]) for x in examples if x.target >= 0]
    assert said == [t for r, t in turns if r == "assistant"]


def test_escape_hides_control_strings():
    for t in NASTY:
        assert "|" not in escape(t) and unescape(escape(t)) == t


def test_contexts_are_whole_prefixes():
    turns = [("system", "s|"), ("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", "b\\"), ("user", "end")]
    texts = [read_turns(x.text) for x in expand(turns)]
    assert texts == [turns[:3], turns[:5], turns]
    assert [x.target for x in expand(turns)] == [2, 4, -1]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_frames(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*NASTY, None])) for c in [1, 2, 3, None] for t in range(rng.randint(1, 7))]
    rows += [(9, 0, "user", "x"), (9, 0, "user", "x"), (9, None, "assistant", "y")] + [(10, t, "assistant", f"long {t}") for t in range(300)]
    told = {r["conv_id"]: r for r in digest_chats(format_chats(rows_of(spark, rows).repartition(5))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    import hashlib

    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        said = "".join(t for r, t in turns if r == "assistant")
        examples = list(expand(turns))
        assert tuple(told[c])[1:] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(x.text) for x in examples))
    assert len(told) == len({r[0] for r in rows})
    assert format_chats(rows_of(spark, rows).limit(0)).count() == 0
