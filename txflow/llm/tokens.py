"""Token counts of whole texts, long ones in overlapping chunks spliced at proven boundaries.

A text longer than ``chunk`` characters is encoded in pieces that overlap by ``overlap``
characters, with the place of each token. Two neighbouring pieces are spliced at a place in their
overlap where both begin a token and the pair of characters across it is *stable*: no vocabulary
entry holds this pair, so that no merge, in any context, can join its two sides. What lies left of
such a place is encoded the same whatever follows, and what lies right of it whatever precedes.
If an overlap holds no such place, the document is encoded again with wider overlaps, in the end as
one piece. Chunks of one document are spread over the tasks, so a giant text does not hold up one.

The proof needs a model that passes text through (identity normaliser, spaces kept). Other models
encode each text whole.

Defined cases: a null text is empty and has 0 tokens; repeated rows and ids each get a row; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import filled, numbered, slices
from txflow.session import cut

CHUNK = 16_384
OVERLAP = 256
SPACE = "▁"

IDS = ("_row", "_key", "n_bytes", "n_chars")
_PIECES = pa.schema([("seq", pa.int32()), ("last", pa.bool_()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("piece", pa.string())])
_CODED = pa.schema([
    ("seq", pa.int32()), ("last", pa.bool_()), ("n_tokens", pa.int64()),
    *((c, pa.list_(pa.int64())) for c in ("head", "head_before", "tail", "tail_before")),
])


class PieceModel:
    """A sentencepiece model and the character pairs that its vocabulary can join."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(open(path, "rb").read())
        rule = proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces if p.type in (1, 4, 5)]  # normal, user-defined, unused
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known = {c for p in pieces for c in p}
        self.bytes = proto.trainer_spec.byte_fallback
        self.splits = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and proto.trainer_spec.model_type == 2

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.coder.encode(texts, num_threads=1)]

    def stable(self, left: str, right: str) -> bool:
        left, right = (SPACE if c == " " else c for c in (left, right))
        # Without byte fallback neighbouring unknown characters become one token.
        return left + right not in self.pairs and (self.bytes or left in self.known or right in self.known)

    def places(self, text: str) -> tuple[int, list[int]]:
        """Number of tokens, and where each begins."""
        found = self.coder.encode(text, return_type="proto").pieces
        begins = np.fromiter((p.begin for p in found), np.int64, len(found))  # in bytes
        inside = np.frombuffer(text.encode(), np.uint8) & 0xC0 == 0x80  # bytes that continue a character
        return len(found), (begins - np.concatenate(([0], np.cumsum(inside)))[begins]).tolist()


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _boundaries(coder: PieceModel, text: str, begins: list[int], low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """Stable places in [low, high] where a token begins, and the tokens before each."""
    at, before = [], []
    for i, b in enumerate(begins):
        if b > high:
            break
        if b >= low and 0 < b < len(text) and (i == 0 or begins[i - 1] < b) and coder.stable(text[b - 1], text[b]):
            at.append(start + b)
            before.append(i)
    return at, before


def _cut_pieces(path: str, chunk: int, overlap: int):
    """Counts the tokens of short texts; gives a row for each piece of a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                size = chunk if coder.splits else 1 << 62
                at = [i for i, t in enumerate(texts) if len(t) <= size]
                rows = [(0, True, n, 0, None) for n in coder.count([texts[i] for i in at])]
                yield _carry(b, at, rows)
                for i, text in enumerate(texts):
                    for seq, start in enumerate(range(0, len(text), size) if len(text) > size else ()):
                        yield _carry(b, [i], [(seq, start + size >= len(text), None, start, text[start : start + size + overlap])])

    return run


def _carry(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of pieces beside the id columns of the texts they come from."""
    kept = [b.column(c).take(pa.array(at, pa.int64())) for c in IDS]
    own = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PIECES)]
    return pa.RecordBatch.from_arrays([*kept, *own], names=[*IDS, *_PIECES.names])


def _encode_pieces(path: str, chunk: int, overlap: int):
    """Counts the tokens of pieces and lists the stable boundaries in their overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for whole in batches:
            for b in slices(whole, "piece"):
                rows = []
                for r in b.select(_PIECES.names).to_pylist():
                    n, head, tail = r["n_tokens"], ([], []), ([], [])
                    if r["piece"] is not None:
                        n, begins = coder.places(r["piece"])
                        if r["seq"]:
                            head = _boundaries(coder, r["piece"], begins, 1, overlap, r["start"])
                        if not r["last"]:
                            tail = _boundaries(coder, r["piece"], begins, chunk, chunk + overlap, r["start"])
                    rows.append((r["seq"], r["last"], n, *head, *tail))
                own = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CODED)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in IDS), *own], names=[*IDS, *_CODED.names])

    return run


def _pass(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """The id columns and n_tokens, which is NULL where two pieces share no stable boundary."""
    ids = T.StructType([docs.schema[c] for c in IDS])
    as_rows = lambda *fields: T.StructType([*ids.fields, *(T.StructField(n, t) for n, t in fields)])
    head = (("seq", T.IntegerType()), ("last", T.BooleanType()), ("n_tokens", T.LongType()))
    longs = T.ArrayType(T.LongType())
    pieces = docs.mapInArrow(_cut_pieces(path, chunk, overlap), as_rows(*head, ("start", T.LongType()), ("piece", T.StringType())))
    coded = pieces.repartition("_row", "seq").mapInArrow(
        _encode_pieces(path, chunk, overlap), as_rows(*head, *((c, longs) for c in ("head", "head_before", "tail", "tail_before"))))
    w = Window.partitionBy("_row").orderBy("seq")
    spliced = coded.withColumns({
        "_left": F.array_min(F.array_intersect(F.lag("tail").over(w), "head")),
        "_right": F.array_min(F.array_intersect("tail", F.lead("head").over(w))),
    })

    def before(place, at, counts):
        return F.element_at(F.col(counts), F.array_position(at, F.col(place)).cast("int"))

    first = F.when(F.col("seq") == 0, F.lit(0)).when(F.col("_left").isNotNull(), before("_left", "head", "head_before"))
    end = F.when(F.col("last"), F.col("n_tokens")).when(F.col("_right").isNotNull(), before("_right", "tail", "tail_before"))
    own = spliced.withColumn("_own", (end - first).cast("long"))
    total = F.when(F.count("_own") == F.count(F.lit(1)), F.sum("_own"))
    return own.groupBy("_row").agg(*[F.first(c).alias(c) for c in IDS[1:]], total.alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_chars, n_tokens) of every row; equal to encoding each text whole."""
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("an overlap must be at most half a chunk")
    base = numbered(docs.select(F.col(key).alias("_key"), filled(text).alias("text"))).withColumns({
        "n_bytes": F.octet_length("text").cast(T.LongType()), "n_chars": F.length("text").cast(T.LongType())})
    done, left = [], base
    while True:
        counted = cut(_pass(left, path, chunk, overlap))
        done.append(counted.filter("n_tokens IS NOT NULL"))
        failed = counted.filter("n_tokens IS NULL").select("_row")
        if failed.isEmpty():
            break
        failed = cut(failed)  # so that the planner sees how small it is
        overlap *= 4
        chunk = max(chunk, 2 * overlap)
        left = base.join(failed, "_row", "left_semi")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_key").alias(key), "n_bytes", "n_chars", "n_tokens")
