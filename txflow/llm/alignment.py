"""Alignment of two tokenizers' tokens of the same texts, as a pipeline over Arrow tables.

Texts come in slices. In each slice the token lists of both tokenizers are flattened with their parent
indices, cumulative sums of the tokens' bytes, restarted at each document, give the byte where every token
ends, and a hash join on (document, end) finds the ends that both have: they cut a document into
groups. Inside a group the ids of each side are counted first and then joined on the group, so a group's links
are products of counts, never listed one by one. ``Table.group_by`` sums them for each document and counts, for every pair of
ids, the slice's documents that hold it. Spark adds up these partial counts over all slices; the totals
return to the slices with the best count of each A id, and a second Arrow pass adds them up for each document.

Tokenizers see each word once while a worker remembers it: where a space between two characters that are no white space starts a
token in both vocabularies, a text is its words' tokens in a row. Other texts are encoded whole.

Defined cases: null and empty texts have no tokens, and neither have texts whose tokens' bytes, joined, differ
from space + text on either side (a U+2581 in the text, say); repeated rows and ids are documents of their own; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import filled, single_threaded, slices
from txflow.session import cut

SLICE_BYTES = 1 << 20
REMEMBERED = 400_000  # words a worker keeps; results do not depend on it
SPACE = "▁"

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
# A document's row has counts and its links by pair number; a slice's row has its pairs.
_PASS = pa.schema([
    ("_slice", pa.int64()), ("_at", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups", pa.string()),
    ("_pair", pa.list_(pa.int32())), ("_links", pa.list_(pa.int64())),
    ("_a", pa.list_(pa.int32())), ("_b", pa.list_(pa.int32())), ("_docs", pa.list_(pa.int64())),
])


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level vocabulary of ``tokenizers``; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = _byte_characters()
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        self.splits = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece vocabulary, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(open(path, "rb").read())
        rule = proto.normalizer_spec
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        # No piece goes on after a space that follows something else: merges stay between such spaces.
        apart = not any(c != SPACE and d == SPACE for p in proto.pieces for c, d in zip(p.piece, p.piece[1:]))
        self.splits = (apart and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.add_dummy_prefix
                       and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


class Side:
    """One tokenizer with what the alignment needs of its vocabulary."""

    def __init__(self, path: str):
        self.coder = Pieces(path) if path.endswith(".model") else ByteLevel(path)
        self.bytes = pa.array(self.coder.bytes, pa.large_binary())
        self.lengths = np.array([len(b) for b in self.coder.bytes], np.int64)
        names = np.arange(len(self.lengths)).astype(str)
        # Ids as text before the next of the same side, before the other side, and at a group's end.
        self.names = pa.concat_arrays([pa.array(np.char.add(names, end), pa.large_string()) for end in ",|;"])


@cache
def side(path: str) -> Side:
    return Side(path)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    before = _offsets(lengths)[:-1]
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _lists(offsets: np.ndarray, ids: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32()))


def _encode(coder, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the words' tokens."""
    found = coder.encode(words)
    n = np.fromiter(map(len, found), np.int64, len(found))
    return _offsets(n), np.fromiter((i for x in found for i in x), np.int32, int(n.sum()))


class Words:
    """Words a worker has met, with their tokens on both sides; it starts anew when there are too many."""

    def __init__(self, sides: list[Side]):
        self.sides = sides
        self.splits = all(s.coder.splits for s in sides)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = [np.zeros(1, np.int64) for _ in self.sides]
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Offsets and ids of the stored words and, after them, of ``texts``."""
        out = []
        for s, starts, ids in zip(self.sides, self.starts, self.ids, strict=True):
            more, own = _encode(s.coder, texts)
            out.append((np.concatenate((starts, starts[-1] + more[1:])), np.concatenate((ids, own))))
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """Where the (distinct) words are stored."""
        if len(self.place) > REMEMBERED:
            self._clear()
        new = [w for w in words if w not in self.place]
        found, n = self.encoded(new), len(self.place)
        self.starts, self.ids = [x for x, _ in found], [y for _, y in found]
        self.place.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


@cache
def words_of(a_path: str, b_path: str) -> Words:
    return Words([side(a_path), side(b_path)])


def token_lists(texts: pa.LargeStringArray, known: Words) -> list[pa.LargeListArray]:
    """The tokens of space + text on each side."""
    parts = pc.split_pattern(texts, " ")
    if not known.splits:
        parts = pa.LargeListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int64()), texts)
    coded = parts.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    ends = parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    # White space at a part's edge may join the space beside it, so such a text is encoded whole.
    edge = pc.match_substring_regex(words, r"^$|^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$").to_numpy(zero_copy_only=False)
    whole = np.add.reduceat(edge[code], ends[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    if not known.splits:
        whole[:] = True
    used = np.zeros(len(words), bool)
    used[code[np.repeat(~whole, np.diff(ends))]] = True
    place = np.zeros(len(words), np.int64)
    place[used] = known.places(words.filter(pa.array(used)).to_pylist())
    # Every text as a list of units: its words, or itself.
    count = np.where(whole, 1, np.diff(ends))
    first = _offsets(count)
    unit = np.empty(int(count.sum()), np.int64)
    unit[_ranges(first[:-1][~whole], count[~whole])] = place[code[np.repeat(~whole, np.diff(ends))]]
    unit[first[:-1][whole]] = len(known.place) + np.arange(int(whole.sum()))
    out = []
    for start, ids in known.encoded(texts.filter(pa.array(whole)).to_pylist()):
        n = np.diff(start)[unit]
        out.append(_lists(_offsets(n)[first], ids[_ranges(start[:-1][unit], n)]))
    return out


def _same_bytes(tokens: pa.LargeListArray, own: Side, texts: pa.Array) -> np.ndarray:
    """Whether the tokens' bytes, joined, are space + text."""
    joined = pa.LargeListArray.from_arrays(tokens.offsets, own.bytes.take(tokens.values))
    wanted = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())).cast(pa.large_binary())
    return pc.equal(pc.binary_join(joined, pa.scalar(b"", pa.large_binary())), wanted).to_numpy(zero_copy_only=False)


class _Flat:
    """The tokens of one side of a slice: ids, parent documents and the bytes where they end in their documents."""

    def __init__(self, tokens: pa.LargeListArray, own: Side):
        self.ids = pc.list_flatten(tokens).to_numpy()
        self.doc = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
        self.n = pc.list_value_length(tokens).to_numpy().astype(np.int64)
        upto = np.cumsum(own.lengths[self.ids])
        first = _offsets(self.n)[:-1]
        before = np.concatenate(([0], upto))[first]
        self.end = upto - np.repeat(before, self.n)  # restarted at each document
        self.table = pa.table({"doc": self.doc, "end": self.end, "at": np.arange(len(self.ids))})

    def cut(self, common: pa.ChunkedArray) -> None:
        """Numbers the groups; ``common`` has the tokens whose ends both sides share."""
        self.last = np.zeros(len(self.ids), bool)
        self.last[common.to_numpy()] = True
        self.group = np.cumsum(self.last) - self.last


def align(a_lists: pa.LargeListArray, b_lists: pa.LargeListArray, a_side: Side, b_side: Side) -> tuple[_Flat, _Flat]:
    """Both sides flattened, their tokens numbered by group over the whole slice."""
    a, b = _Flat(a_lists, a_side), _Flat(b_lists, b_side)
    common = a.table.rename_columns(["doc", "end", "a"]).join(b.table.rename_columns(["doc", "end", "b"]), keys=["doc", "end"], join_type="inner", use_threads=False)
    a.cut(common.column("a"))
    b.cut(common.column("b"))
    return a, b


def _written(a: _Flat, b: _Flat, a_side: Side, b_side: Side, docs: int) -> pa.LargeStringArray:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    groups = int(a.last.sum())
    a_sizes, b_sizes = np.bincount(a.group, minlength=groups), np.bincount(b.group, minlength=groups)
    a_place = np.arange(len(a.ids)) + _offsets(b_sizes)[a.group]
    b_place = np.arange(len(b.ids)) + _offsets(a_sizes)[b.group + 1]
    text, which = np.empty(len(a.ids) + len(b.ids), np.int64), len(a_side.lengths)
    text[a_place] = a.ids + which * a.last
    text[b_place] = 3 * which + b.ids + len(b_side.lengths) * 2 * b.last
    names = pa.concat_arrays([a_side.names, b_side.names])
    each = pa.LargeListArray.from_arrays(pa.array(_offsets(a.n + b.n)), names.take(pa.array(text)))
    return pc.utf8_rtrim(pc.binary_join(each, pa.scalar("", pa.large_string())), characters=";")


def _links(a: _Flat, b: _Flat) -> pa.Table:
    """(doc, a, b, links): how many pairs of occurrences share a group."""
    groups = int(a.last.sum())
    a_size, b_size = np.bincount(a.group, minlength=groups), np.bincount(b.group, minlength=groups)
    # Most groups have one token on a side: as many links as the other side has tokens.
    plain = np.flatnonzero(np.minimum(a_size, b_size) == 1)
    most = np.maximum(a_size, b_size)[plain]
    step = _ranges(np.zeros(len(plain), np.int64), most)
    at = np.repeat(plain, most)
    a_at, b_at = (_offsets(size)[at] + step * (size[at] > 1) for size in (a_size, b_size))
    doc_of = a.doc[a.last]  # by group
    direct = pa.table({"doc": doc_of[at], "a": a.ids[a_at], "b": b.ids[b_at], "links": np.ones(len(at), np.int64)})
    # The others count the ids of either side before these meet, so a long group gives no row for each pair of places.
    mixed = np.minimum(a_size, b_size) > 1

    def counted(x: _Flat, name: str) -> pa.Table:
        own = mixed[x.group]
        return pa.table({"group": x.group[own], name: x.ids[own]}).group_by(["group", name], use_threads=False).aggregate(
            [([], "count_all")]).rename_columns(["group", name, f"n_{name}"])

    joined = counted(a, "a").join(counted(b, "b"), keys="group", join_type="inner", use_threads=False)
    product = pa.table({"doc": doc_of[joined.column("group").to_numpy()], "a": joined.column("a"), "b": joined.column("b"),
                        "links": pc.multiply(joined.column("n_a"), joined.column("n_b"))})
    return pa.concat_tables([direct, product]).group_by(["doc", "a", "b"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["doc", "a", "b", "links"])


def _align_slice(texts: pa.Array, known: Words) -> tuple[dict[str, pa.Array], pa.Table]:
    """The document columns of a slice, and its pairs (pair, a, b, docs)."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    a_side, b_side = known.sides
    a_lists, b_lists = token_lists(texts, known)
    right = _same_bytes(a_lists, a_side, texts) & _same_bytes(b_lists, b_side, texts) & (pc.binary_length(texts).to_numpy() > 0)
    kept = pa.array(np.flatnonzero(right))
    a, b = align(a_lists.take(kept), b_lists.take(kept), a_side, b_side)
    rows = kept.to_numpy()

    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(n, np.int64)
        out[rows] = values
        return pa.array(out)

    digests = np.full(n, "", object)
    written = _written(a, b, a_side, b_side, len(rows))
    digests[rows] = [hashlib.sha256(memoryview(s.as_buffer())).hexdigest() for s in written]
    links = _links(a, b)
    key = pc.add(pc.multiply(links.column("a").cast(pa.int64()), pa.scalar(1 << 31)), links.column("b").cast(pa.int64()))
    coded = key.combine_chunks().dictionary_encode()
    pair = coded.indices.to_numpy()
    keys = coded.dictionary.to_numpy()
    pairs = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    order = np.argsort(links.column("doc").to_numpy(), kind="stable")
    doc, amount = links.column("doc").to_numpy()[order], links.column("links").to_numpy()[order]
    per_doc = spread(np.bincount(doc, minlength=len(rows)))
    ends = pa.array(_offsets(per_doc.to_numpy()), pa.int32())
    columns = {
        "n_a": spread(a.n), "n_b": spread(b.n), "n_groups": spread(np.bincount(a.doc[a.last], minlength=len(rows))),
        "n_links": spread(np.bincount(doc, amount, minlength=len(rows)).astype(np.int64)), "groups": pa.array(digests, pa.string()),
        "_pair": pa.ListArray.from_arrays(ends, pa.array(pair[order], pa.int32())), "_links": pa.ListArray.from_arrays(ends, pa.array(amount, pa.int64())),
    }
    return columns, pa.table({"a": pa.array((keys >> 31).astype(np.int32)), "b": pa.array((keys & ((1 << 31) - 1)).astype(np.int32)), "docs": pairs.column("count_all")})


def _first_pass(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_of(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                columns, pairs = _align_slice(b.column("text"), known)
                n = b.num_rows
                columns |= {"_slice": pa.array(np.full(n, number)), "_at": pa.array(np.arange(n))}
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key"), *(columns.get(f.name, pa.nulls(n, f.type)) for f in _PASS)], names=["_key", *_PASS.names])
                own = {"_slice": pa.array([number])} | {
                    f"_{c}": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs.column(c).combine_chunks()) for c in ("a", "b", "docs")}
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, b.schema.field("_key").type), *(own.get(f.name, pa.nulls(1, f.type)) for f in _PASS)], names=["_key", *_PASS.names])
                number += 1

    return run


def _second_pass(names: list[str]):
    """Adds up the totals of each document's links; both tables hold one slice."""
    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("_pair")
        count, best = pairs.column("_count").to_numpy(), pairs.column("_best").to_numpy().astype(bool)
        pair_lists = docs.column("_pair").combine_chunks()
        parent = pc.list_parent_indices(pair_lists).to_numpy()
        pair = pc.list_flatten(pair_lists).to_numpy()
        links = pc.list_flatten(docs.column("_links").combine_chunks()).to_numpy()
        own = pa.table({"doc": parent, "count_sum": count[pair] * links, "n_best": np.where(best[pair], links, 0)}) if len(pair) else None
        sums = np.zeros((2, docs.num_rows), np.int64)
        if own is not None:
            found = own.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
            sums[:, found.column("doc").to_numpy()] = [found.column("n_best_sum").to_numpy(), found.column("count_sum_sum").to_numpy()]
        kept = docs.select(names)
        return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the pair counts (a, b, docs, best)."""
    df = docs.select(F.col(f"`{key}`").alias("_key"), filled(text).alias("text"))
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.list_(pa.int32()): ints, pa.list_(pa.int64()): longs}
    found = cut(df.mapInArrow(_first_pass(a_path, b_path), T.StructType(
        [T.StructField("_key", df.schema["_key"].dataType), *(T.StructField(f.name, kinds[f.type]) for f in _PASS)])))
    slice_pairs = found.filter("_a IS NOT NULL").select(
        "_slice", F.posexplode(F.arrays_zip(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_docs").alias("docs"))).alias("_pair", "p")).select(
        "_slice", "_pair", "p.a", "p.b", "p.docs")
    totals = slice_pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    # The rows of an A id are its partners, no more than B's vocabulary has.
    totals = cut(totals.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a"))))
    # Both sides grow with the corpus, so neither is broadcast while it happens to be small.
    known = slice_pairs.drop("docs").join(totals.hint("merge"), ["a", "b"]).select(F.col("_slice").alias("_of"), "_pair", F.col("docs").alias("_count"), F.col("best").cast("int").alias("_best"))
    names = ["_key", *_COUNTS, "groups"]
    rows = found.filter("_a IS NULL").select("_slice", *names, "_pair", "_links")
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    summed = rows.groupBy("_slice").cogroup(known.groupBy("_of")).applyInArrow(_second_pass(names), schema)
    per_doc = summed.select(F.col("_key").alias(key), *_COUNTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
    return per_doc, totals
