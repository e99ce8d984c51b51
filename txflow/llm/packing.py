"""Packing by concatenate-and-cut.

First pass: each task encodes its documents, notes how many ids of its partition lie before each, and
the ids are written with these places. One row per partition holds its total; their prefix sums are
the partitions' places in the whole. Second pass: document start = partition start + place inside, and
each document is cut where a window of ``length`` ids ends. Pieces of a window that two partitions
share meet by its number, so no partition waits for another and nothing but the totals is summed
in one place. All windows but the last are full.

Encoding goes word by word: a space between two characters that are not white space always begins a token,
so the parts between such spaces are encoded once, by the tokenizer, and looked up
from then on. A line end between two such characters is a token of its own, so a part is put together from its lines.
Texts with other white space around their spaces are encoded whole. New parts go to the tokenizer as one text, many at a time.

Defined cases: a null text is empty, its document consists of the end id alone; repeated rows and ids
are packed each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import filled, single_threaded, slices
from txflow.session import cut

LENGTH = 2048
END_ID = 1
REMEMBERED = 300_000  # parts of a generation that a worker keeps; results do not depend on it
JOINED = 1000  # new parts that the tokenizer gets as one text

# A word of Latin letters and digits and signs after it: two tokens of the pre-tokenizer, whatever follows a space.
_TAILED = re.compile(r"([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]+)")


class Remembered(dict):
    """Parts and their ids in two generations: what was used lately survives when the older one goes."""

    older: dict = {}

    def renew(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()

    def missing(self, parts: Iterable[str]) -> list[str]:
        """Parts that are not known; those of the older generation move up."""
        new = set(filterfalse(self.__contains__, parts))
        for p in filter(self.older.__contains__, new):
            self[p] = self.older[p]
        return list(filterfalse(self.__contains__, new))


class WordCoder:
    """Encodes texts as 32-bit ids (16-bit if the vocabulary allows)."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = np.dtype(self.code)
        self.first, self.later = Remembered(), Remembered()
        vocabulary = self.tokenizer.get_vocab()
        # Ids that begin with a space or a line end: where parts joined by one come apart again.
        self.begins = {c: np.zeros(max(vocabulary.values(), default=0) + 1, bool) for c in " \n"}
        for entry, i in vocabulary.items():
            self.begins[" "][i] = entry.startswith("Ġ")
            self.begins["\n"][i] = entry.startswith("Ċ")
        self.line_end = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _encode_parts(self, parts: list[str], before: str) -> list[bytes]:
        """As ``_encode`` of each part after ``before``; the parts have no white space at their ends, and no line end if ``before`` is empty."""
        out, between = [], before or "\n"
        groups = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        for own, raw in zip(groups, self._encode([between + between.join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.begins[between][np.frombuffer(raw, self.width)]) * self.width.itemsize
            if len(at) != len(own):  # a tokenizer that has other tokens at such places
                out += self._encode([before + p for p in own])
                continue
            skip = 0 if before else self.width.itemsize  # the line end's own id
            out += [raw[x + skip : y] for x, y in zip(at.tolist(), [*at[1:].tolist(), len(raw)], strict=True)]
        return out

    def _learn(self, known: Remembered, parts: Iterable[str], before: str) -> None:
        new, rough, tailed, lined = [], [], [], []
        for p in known.missing(parts):
            if p.isalpha():
                new.append(p)
            elif not p or p.strip() != p:
                known[p] = None  # the white space beside the space may join it
            elif "\n" in p:
                lines = p.split("\n")
                if all(x and x.strip() == x for x in lines):
                    lined.append((p, lines))
                else:
                    (new if before else rough).append(p)
            elif m := _TAILED.fullmatch(p):
                tailed.append((p, *m.groups()))  # a word and the signs after it are tokens apart
            else:
                new.append(p)
        if lined:
            self._learn(self.first, {x for _, lines in lined for x in lines[1:]}, "")
            self._learn(known, {lines[0] for _, lines in lined} - set(new) - {p for p, *_ in tailed}, before)
        if tailed:
            new += known.missing({w for _, w, _ in tailed} - set(new))
            self._learn(self.first, {t for *_, t in tailed}, "")
        known.update(zip(new, self._encode_parts(new, before), strict=True))
        known.update(zip(rough, self._encode(rough), strict=True))
        known.update((p, known[w] + self.first[t]) for p, w, t in tailed)
        known.update((p, self.line_end.join([known[lines[0]], *map(self.first.__getitem__, lines[1:])])) for p, lines in lined)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(texts, " ")
        parts, n = split.flatten(), pc.list_value_length(split).to_numpy()
        begins = np.zeros(len(parts), bool)
        begins[np.cumsum(n) - n] = True
        heads = parts.filter(pa.array(begins)).to_pylist()
        rest = parts.filter(pa.array(~begins)).dictionary_encode()
        own = rest.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.first.renew()
        self.later.renew()
        self._learn(self.first, heads, "")
        self._learn(self.later, own, " ")
        # The ids of the parts in their order, one after the other: those of a text are a stretch of them.
        found = pa.array(list(map(self.later.__getitem__, own)), pa.large_binary()).take(rest.indices)
        joined, ends = pc.binary_length(found).fill_null(0).to_numpy(), np.cumsum(n - 1)
        place = np.concatenate(([0], np.cumsum(joined)))[np.concatenate(([0], ends))].tolist()
        raw = memoryview(found.buffers()[2] or b"")
        out = [b"" if h is None else h + raw[x:y] for h, x, y in zip(map(self.first.__getitem__, heads), place, place[1:], strict=False)]
        odd = {i for i, h in enumerate(heads) if self.first[h] is None}
        odd.update(np.searchsorted(ends, np.flatnonzero(found.is_null()), side="right").tolist())
        whole = sorted(odd)
        for i, ids in zip(whole, self._encode(texts.take(pa.array(whole, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        return out


@cache
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place, part = coder(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], words.width).tobytes()
        for whole in batches:
            for b in slices(whole, "text"):
                ids = [x + end for x in words.encode(b.column("text"))]
                n = np.array([len(x) // words.width.itemsize for x in ids], np.int64)
                before = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key"), pa.array(np.full(len(n), part, np.int64)), pa.array(before), pa.array(n), pa.array(ids, pa.binary())],
                    names=["_key", "_part", "_before", "_n", "_ids"])

    return run


_PIECE = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()))


def _cut_rows(length: int, with_ids: bool):
    names = [n for n, _ in _PIECE if with_ids or n != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_ids"):
                at, out = [], []
                for i, (place, n, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_place", "_n", "_ids")), strict=True)):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(place + start, length)
                        own = ids[start : start + length - offset].tobytes()
                        at.append(i)
                        out.append((start, len(own) // 4, zlib.crc32(own), n, sequence, offset, own))
                        start += length - offset
                key = b.column("_key").take(pa.array(at, pa.int64()))
                columns = [pa.array([r[k] for r in out], t) for k, (name, t) in enumerate(_PIECE) if name in names]
                yield pa.RecordBatch.from_arrays([key, *columns], names=["_key", *names])

    return run


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (32-bit, little-endian)."""
    df = docs.select(F.col(key).alias("_key"), filled(text).alias("text"))
    own = T.StructField("_key", df.schema["_key"].dataType)
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    encoded = cut(df.mapInArrow(_encode_rows(path, end_id), T.StructType(
        [own, *long("_part", "_before", "_n"), T.StructField("_ids", T.BinaryType())])))
    # One row per partition of the scan.
    totals = encoded.groupBy("_part").agg(F.sum("_n").alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that the planner knows its size and does not shuffle the ids for it while it is small.
    starts = cut(totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start")))
    placed = encoded.join(starts, "_part").select("_key", (F.col("_start") + F.col("_before")).alias("_place"), "_n", "_ids")
    fields = [*long(*(n for n, t in _PIECE if n != "ids")), *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    return placed.mapInArrow(_cut_rows(length, with_ids), T.StructType([own, *fields])).withColumnRenamed("_key", key)


def boundary_records(pieces: DataFrame) -> DataFrame:
    """(sequence_id, pieces, length) of the windows that more than one piece fills."""
    return pieces.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("length")).filter("pieces > 1")


def padded(n: int, length: int = LENGTH) -> int:
    """Length a sequence of n ids is padded to: a power of two stays as it is."""
    return n if n & (n - 1) == 0 else length


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, input_ids, n_tokens): windows put together, the last padded with zeros as ``padded`` says."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``length`` pieces
    joined = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cut_parts in b.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in cut_parts), "<u4")
                rows.append(np.pad(ids, (0, padded(len(ids), length) - len(ids))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("sequence_id"), pa.array(rows, pa.list_(pa.int32())), b.column("n_tokens")], names=["sequence_id", "input_ids", "n_tokens"])

    return joined.mapInArrow(run, "sequence_id long, input_ids array<int>, n_tokens long")
