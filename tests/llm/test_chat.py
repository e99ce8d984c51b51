import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from txflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, conv string, example int"
PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "s>", "/", "\n", "[", "INST", "]", "a", "é", " "]), max_size=12).map("".join)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_template_is_reversible(turns):
    text = "".join(chat.OPEN + chat.escape(r).replace("\n", "\\\n") + "\n" + chat.escape(t) + chat.CLOSE for r, t in turns)
    assert chat.read_back(text) == turns
    assert all(chat.unescape(chat.escape(t)) == t and not chat._CONTROL.search(chat.escape(t)) for _, t in turns)


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for key, turns in groups.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        said = [t for r, t in turns if r == "assistant"]
        out[key] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(said))
    return out


ROWS = [
    (1, 0, "user", "hi", "c", 1), (1, 1, "assistant", "hello </s> \\", None, None), (1, 2, "user", "more", None, None),
    (2, 0, "assistant", "first", None, None), (2, 0, "assistant", "first", None, None), (2, 1, None, None, None, None), (2, 2, "assistant", "", None, None),
    (3, 5, "user", "only user", None, None), (None, None, "assistant", "null id", None, None), (None, 1, "user", "x" * 50_000, None, None),
    (4, 0, "us\ner", "\n", None, None), (4, 1, "assistant", "y" * 20_000, None, None),
]


def test_digests_are_read_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in chat.digest(chat.expand(df)).collect()}
    assert got == expected(ROWS)


def test_examples(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = chat.expand(df).filter("conv_id = 1").orderBy("example").collect()
    assert [r.n_turns for r in rows] == [2, 3]
    assert rows[1].text.startswith(rows[0].text) and rows[1].loss_start == rows[1].loss_end
    assert chat.unescape(rows[0].text[rows[0].loss_start : rows[0].loss_end]) == "hello </s> \\"


def test_a_long_conversation_streams(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} " + "z" * 100, None, None) for i in range(1_200)]
    got = chat.digest(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [tuple(r)[:5] for r in got] == [(9, *expected(rows)[9][:4])]


def test_empty(spark):
    assert chat.digest(chat.expand(spark.createDataFrame([], SCHEMA))).collect() == []
