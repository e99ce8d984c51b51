"""Chat formatting by prefix-target expansion: one example for each assistant turn.

A turn is written as ``<s>role\\ntext</s>``. An example is all turns up to and including one
assistant turn; only the text of that turn is trainable (``loss_start`` to ``loss_end``, in
characters). Turns after the last assistant turn come as one more row with an empty loss span, so
that nothing of a conversation is lost; trainers skip it. Control strings inside roles and texts
are escaped by a backslash after their first character, backslashes are doubled, and a newline in a
role gets one before it; ``read_back`` undoes all of this.

Turns are sorted by (turn, role, text) inside a conversation and streamed: a task holds one prefix at
a time and gives its examples in batches bounded by their size, so a very long conversation needs
memory for its text, not for all its examples.

Defined cases: a null text or role is empty; null conversation ids form one conversation; turns with
the same number follow each other; repeated rows are turns of their own; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import filled, slices

OPEN, CLOSE = "<s>", "</s>"
CONTROLS = ("<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"
BATCH_CHARS = 4 << 20

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>((?:\\.|[^\\\n])*)\n(.*?)</s>", re.DOTALL)
_EXAMPLE = ("example", "n_turns", "text", "loss_start", "loss_end")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, started, prefix, size, turns, given, done = None, False, [], 0, 0, 0, 0
    out, chars, kind = [], 0, None

    def flush() -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in out], kind), *(
            pa.array([r[k + 1] for r in out], pa.string() if c == "text" else pa.int64()) for k, c in enumerate(_EXAMPLE))]
        return pa.RecordBatch.from_arrays(columns, names=["conv", *_EXAMPLE])

    def rest() -> list[tuple]:
        return [(key, given, turns, "".join(prefix), size, size)] if turns > done else []

    for b in batches:
        kind = b.schema.field("conv").type
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if not started or conv != key:
                tail = rest()
                out += tail
                chars += sum(len(r[3]) for r in tail)
                key, started, prefix, size, turns, given, done = conv, True, [], 0, 0, 0, 0
            head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
            body = escape(text)
            prefix = ["".join((*prefix, head, body, CLOSE))]
            start = size + len(head)
            size, turns = start + len(body) + len(CLOSE), turns + 1
            if role == TRAINED:
                out.append((key, given, turns, prefix[0], start, start + len(body)))
                chars += size
                given, done = given + 1, turns
            if chars > BATCH_CHARS:
                yield flush()
                out, chars = [], 0
    if started:
        out += rest()
        yield flush()


def expand(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, example, n_turns, text, loss_start, loss_end); an empty loss span marks turns after the last reply."""
    df = conversations.select(
        F.col(key).alias("conv"), "turn", filled("role").alias("role"), filled("text").alias("text"))
    # A conversation's examples are prefixes of one another: one task writes them in order.
    ordered = df.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    schema = T.StructType([T.StructField("conv", df.schema["conv"].dataType), *(
        T.StructField(c, T.StringType() if c == "text" else T.LongType()) for c in _EXAMPLE)])
    return ordered.mapInArrow(_expand, schema).withColumnRenamed("conv", key)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def close(s: dict) -> dict:
        return {"conv": s["conv"], "n_turns": s["n_turns"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"],
                "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["formatted_chars"], "n_examples": s["n_examples"]}

    state: dict | None = None
    for b in (part for whole in batches for part in slices(whole, "text")):
        out, kind = [], b.schema.field("conv").type
        for r in b.to_pylist():
            if state is None or r["conv"] != state["conv"]:
                if state:
                    out.append(close(state))
                state = {"conv": r["conv"], "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n_turns": 0, "loss_chars": 0,
                         "formatted_chars": 0, "n_examples": 0, "end": 0}
            loss = unescape(r["text"][r["loss_start"] : r["loss_end"]])
            for role, text in read_back(r["text"][state["end"] :]):
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["n_turns"] += 1
            state["end"] = len(r["text"])
            state["loss"].update(loss.encode())
            state["loss_chars"] += len(loss)
            state["formatted_chars"] += len(r["text"])
            state["n_examples"] += r["loss_end"] > r["loss_start"] or r["text"].endswith(CLOSE) and r["loss_end"] < len(r["text"])
        yield _digests(out, kind)
    if state:
        yield _digests([close(state)], kind)


_SUMS = (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()),
         ("formatted_chars", T.LongType()), ("n_examples", T.LongType()))


def _digests(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([r["conv"] for r in rows], kind)]
    columns += [pa.array([r[n] for r in rows], pa.string() if isinstance(t, T.StringType) else pa.int64()) for n, t in _SUMS]
    return pa.RecordBatch.from_arrays(columns, names=["conv", *(n for n, _ in _SUMS)])


def digest(examples: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the examples hold, read back from their texts: turns, trained text and sizes of each conversation.

    An example repeats the one before it, so only what it adds is read.
    """
    df = examples.withColumnRenamed(key, "conv").repartition("conv").sortWithinPartitions("conv", "example")
    schema = T.StructType([T.StructField("conv", df.schema["conv"].dataType), *(T.StructField(n, t) for n, t in _SUMS)])
    return df.select("conv", "text", "loss_start", "loss_end").mapInArrow(_digest, schema).withColumnRenamed("conv", key)
