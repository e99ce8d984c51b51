"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a window of tokens: the hashes of the tokens at its marked positions are
combined, the others are ignored, so a substitution at an ignored position leaves the seed as it is.
Seeds of the documents are joined with those of the benchmark. Around a hit a document and an item are
laid over each other and compared token by token; an alignment counts if some stretch of ``STRETCH``
tokens (the whole item, if that is shorter) agrees in ``AGREE`` of them. The masks are chosen so that
every stretch that agrees so far holds a seed: none is lost, whatever tokens are substituted. Items of
fewer than ``TOLERANT`` tokens must agree as a whole.

1. Items are cut into segments of ``SEGMENT`` tokens that overlap by a stretch; their seeds are written
   as a table (seed, segment).
2. Documents are scanned once. A Bloom filter over the benchmark's seeds, at most ``FILTER_BITS`` wide,
   goes to the tasks; a larger benchmark lets more windows pass, no block is scanned again. Windows that
   pass are gathered by cells of ``CELL`` tokens; a cell's tokens with a stretch on both sides are a region.
3. Regions with the same tokens become one body, so copies are compared once.
4. (seed, body) joins (seed, segment), salted, since some seeds are in many bodies; each pair of body and
   segment is compared once, at every shift that shares a seed. A region and a segment have bounded
   lengths, so texts of one repeated word cost no more memory than others.

Tokens are maximal runs of letters and digits of the lower-case text; non-ASCII spaces, punctuation and symbols end them
as ASCII ones do. In scripts that put no spaces between words (``NO_SPACES``) each code point is a token.

Defined cases: a null or empty text matches nothing, nor does an item without tokens; an item of one word marks every document
with that word, unless ``shortest`` is raised; repeated rows and ids each get a row; empty tables give an empty table; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import U64, PrefixHash, filled, mix, numbered, packed, slices
from txflow.session import cut

STRETCH = 20
AGREE = 0.75
TOLERANT = 8
_ANY = 1 << 62
# Mask, shortest and longest item that uses it. A test lays every pattern of substitutions over 8 to 20 tokens.
MASKS = (
    ("1101011", 8, _ANY), ("11100101", 8, _ANY), ("1100010011", 10, _ANY), ("11111", 8, _ANY), ("110111", 10, 12), ("10111", 8, 9), ("11000011", 8, 9),
    *(("1" * n, n, n) for n in range(1, TOLERANT)),
)
SEGMENT = 512
CELL = 256
BITS_PER_SEED = 32
PROBES = 6
FILTER_BITS = 1 << 29
SALTS = 8
BUFFER = 1 << 18

_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# First and last code points: Thai, Lao, Tibetan, Myanmar, Khmer, Tai scripts, Han, Kana, Bopomofo, Yi, Javanese.
NO_SPACES = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007),
    (0x3021, 0x3029), (0x3031, 0x303C), (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF),
    (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xAA80, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x33FFF),
)
_APART, _WORD, _ALONE = 0, 1, 2
_LAST = 0x34000  # this and the code points above it count as letters


def _kinds() -> np.ndarray:
    kinds = np.full(_LAST + 1, _WORD, np.uint8)
    for low, high in NO_SPACES:
        kinds[low : high + 1] = _ALONE
    for k in range(0x20000):
        if unicodedata.category(chr(k))[0] in "PSZ" or chr(k).isspace():
            kinds[k] = _APART
    return kinds


_KINDS = _kinds()


def _kind_of_bytes(codes: np.ndarray) -> np.ndarray:
    """Each byte's kind, its code point's; bytes that are no UTF-8 count as letters."""
    kind = _IN_TOKEN[codes].astype(np.uint8)
    at = np.flatnonzero(codes >= 0xC0)
    if not len(at):
        return kind
    b = [np.append(codes, np.zeros(3, np.uint8))[at + k].astype(np.int64) for k in range(4)]
    size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    whole = (b[1] >> 6 == 2) & ((size < 3) | (b[2] >> 6 == 2)) & ((size < 4) | (b[3] >> 6 == 2))
    tail = [x & 63 for x in b]
    point = np.select([size == 2, size == 3], [(b[0] & 31) << 6 | tail[1], (b[0] & 15) << 12 | tail[1] << 6 | tail[2]],
                      (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3])
    found = _KINDS[np.minimum(point, _LAST)]
    for k in range(4):
        here = whole & (k < size)
        kind[at[here] + k] = found[here]
    return kind


def tokens_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each token of lower-case UTF-8 text."""
    codes = np.frombuffer(data, np.uint8)
    kind = _kind_of_bytes(codes)
    before = np.concatenate((np.zeros(1, np.uint8), kind))[: len(kind)]
    opens = (before != kind) | (kind == _ALONE) & (codes >> 6 != 2)  # a token, or what is between two
    edges = np.append(np.flatnonzero(opens), len(codes))
    start, end = edges[:-1], edges[1:]
    inside = kind[start] != _APART
    start, end = start[inside], end[inside]
    return mix(PrefixHash(codes).of(start, end) + (end - start).astype(U64)), start


def seeds(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the marked tokens of each window."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, number + 1, U64)
    for k, mark in enumerate(mask):
        if mark == "1":
            out = (out ^ tokens[k : k + n]) * U64(0x9FB21C651E98DF25)
            out ^= out >> U64(29)
    return mix(out)


def masks_of(length: int) -> list[int]:
    """Numbers of the masks that an item of ``length`` tokens uses."""
    return [k for k, (_, low, high) in enumerate(MASKS) if low <= length <= high]


class Filter:
    """Bloom filter over the seeds of a benchmark: words of 64 bits, a power of two of them."""

    def __init__(self, words: np.ndarray, masks: list[int]):
        self.words, self.masks = words, masks

    def holds(self, key: np.ndarray) -> np.ndarray:
        """Places in ``key`` of the seeds that may be the benchmark's."""
        last = U64(len(self.words) * 64 - 1)
        at, step = np.arange(len(key)), key >> U64(32) | U64(1)
        for k in range(PROBES):
            bit = ((key[at] & last) + U64(k) * step[at]) & last
            at = at[(self.words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63)) & U64(1)).astype(bool)]
        return at


def filter_of(seeds_table: DataFrame, masks: list[int]) -> Filter:
    """The bits are set in a Spark aggregate; as many rows return as the filter has words."""
    bits = min(FILTER_BITS, 1 << max(16, int(seeds_table.count() * BITS_PER_SEED).bit_length()))
    low, step = F.col("seed").bitwiseAND(bits - 1), F.shiftrightunsigned("seed", 32).bitwiseOR(1)
    probe = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda k: (low + k * step).bitwiseAND(bits - 1)))
    word = seeds_table.select(probe.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
    found = word.toArrow()
    words = np.zeros(bits // 64, U64)
    words[found.column("word").to_numpy()] = found.column("set").to_numpy().view(U64)
    return Filter(words, masks)


def regions_of(tokens: np.ndarray, docs: np.ndarray, known: Filter, stretch: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Document, first and last token and seeds of the cells with windows that pass the filter.

    ``docs`` holds the first token of each document, and the end.
    """
    places, keys, spans = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for number in known.masks:
        mask = MASKS[number][0]
        key = seeds(tokens, mask, number)
        at = known.holds(key)
        places.append(at)
        keys.append(key[at])
        spans.append(np.full(len(at), len(mask)))
    place, key, span = np.concatenate(places), np.concatenate(keys), np.concatenate(spans)
    doc = np.searchsorted(docs, place, "right") - 1
    inside = place + span <= docs[doc + 1] if len(place) else np.zeros(0, bool)
    place, key, span, doc = place[inside], key[inside], span[inside], doc[inside]
    cell = (place - docs[doc]) // CELL
    order = np.lexsort((place, cell, doc))
    place, key, span, doc, cell = place[order], key[order], span[order], doc[order], cell[order]
    first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
    for a, b in zip(first, np.append(first, len(place))[1:], strict=True):
        d = doc[a]
        low = max(docs[d], place[a] - stretch)
        high = min(docs[d + 1], (place[a:b] + span[a:b]).max() + stretch)
        yield int(d), int(low), int(high), np.unique(key[a:b])


def best_stretch(region: np.ndarray, segment: np.ndarray, length: int, stretch: int, agree: float) -> tuple[int, int, int, int] | None:
    """Agreeing tokens, their stretch's width and its place in ``region``, of the best of all shifts that share a seed.

    ``length`` is the whole item's number of tokens.
    """
    width = min(stretch, length)
    need = width if length < TOLERANT else agree * width
    shifts = [np.zeros(0, np.int64)]
    for number in masks_of(length):
        mine, theirs = (seeds(t, MASKS[number][0], number) for t in (region, segment))
        order = np.argsort(theirs, kind="stable")
        low, high = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
        count = high - low
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        shifts.append(np.unique(np.repeat(np.arange(len(mine)), count) - order[np.repeat(low, count) + inside]))
    best = None
    for shift in np.unique(np.concatenate(shifts)).tolist():
        low, high = max(0, shift), min(len(region), len(segment) + shift)
        if high - low < width:
            continue
        sums = np.concatenate(([0], np.cumsum(region[low:high] == segment[low - shift : high - shift])))
        found = sums[width:] - sums[:-width]
        at = int(found.argmax())
        if found[at] >= need and (best is None or found[at] > best[0]):
            best = (int(found[at]), width, low + at, low + at + width)
    return best


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = tokens_of(text.encode())[0].view(np.int64)
            for k in range(0, max(1, len(found) - STRETCH), SEGMENT - STRETCH):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([found[k : k + SEGMENT]], pa.list_(pa.int64()))],
                    names=["item", "length", "their_tokens"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Views of the lists of longs."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(U64)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for segment, length, tokens in zip(b.column("segment").to_pylist(), b.column("length").to_pylist(), _lists(b.column("their_tokens")), strict=True):
            found = np.unique(np.concatenate([seeds(tokens, MASKS[k][0], k) for k in masks_of(length)]))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), segment))], names=["seed", "segment"])


_LONGS = T.ArrayType(T.LongType())


def _scan(known, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", BUFFER):
                texts = b.column("text").cast(pa.binary()).to_pylist()
                tokens, at = tokens_of(b"\n".join(texts))
                ends = np.cumsum([len(t) + 1 for t in texts])
                docs = np.concatenate(([0], np.searchsorted(at, ends, "left")))
                found = list(regions_of(tokens, docs, known.value, stretch))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array([r[0] for r in found], pa.int64())) for c, n in zip(b.columns, b.schema.names, strict=True) if n != "text"),
                     pa.array([r[1] - int(docs[r[0]]) for r in found], pa.int64()),
                     pa.array([tokens[r[1] : r[2]].view(np.int64) for r in found], pa.list_(pa.int64())),
                     pa.array([r[3].view(np.int64) for r in found], pa.list_(pa.int64()))],
                    names=[*(n for n in b.schema.names if n != "text"), "start", "tokens", "seeds"])

    return run


_FOUND = "body1 long, body2 long, item long, agreeing long, compared long, low long, high long"


def _compare(stretch: int, agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for k, (mine, theirs, length) in enumerate(zip(_lists(b.column("tokens")), _lists(b.column("their_tokens")), b.column("length").to_pylist(), strict=True)):
                best = best_stretch(mine, theirs, length, stretch, agree)
                if best:
                    rows.append(k)
                    found.append(best)
            kept = b.select(["body1", "body2", "item"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[k] for r in found], pa.int64()) for k in range(4))],
                                             names=["body1", "body2", "item", "agreeing", "compared", "low", "high"])

    return run


def overlaps_with(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  stretch: int = STRETCH, agree: float = AGREE, shortest: int = 1) -> DataFrame:
    """Verified overlaps of ``docs``, which hold ``_row``: the columns of ``docs`` but the text, and (item, agreeing, compared,
    first_token, end_token) of the best stretch of each region with each segment of an item.

    Items of fewer than ``shortest`` tokens are left out. The masks find every stretch for the default ``stretch`` and ``agree`` or stricter ones.
    """
    if stretch > STRETCH:
        raise ValueError(f"segments overlap by {STRETCH} tokens")
    # Items with equal texts are one query; the smallest id stands for them.
    items = benchmark.groupBy(F.lower(filled(item_text)).alias("text")).agg(F.min(item).cast("long").alias("item"))
    parts = items.select("item", "text").mapInArrow(_tokenize, "item long, length long, their_tokens array<long>")
    parts = cut(numbered(parts.filter(F.col("length") >= max(1, shortest)), "segment"))
    theirs = cut(parts.mapInArrow(_seeds_of, "seed long, segment long"))
    lengths = parts.agg(*[F.coalesce(F.bool_or(F.col("length").between(low, high)), F.lit(False)) for _, low, high in MASKS]).first()
    known = docs.sparkSession.sparkContext.broadcast(filter_of(theirs, [k for k, used in enumerate(lengths) if used]))

    carried = [c for c in docs.columns if c != text]
    given = docs.select(*[F.col(c) for c in carried], F.lower(filled(text)).alias("text"))
    kinds = T.StructType([*(docs.schema[c] for c in carried), T.StructField("start", T.LongType()), T.StructField("tokens", _LONGS), T.StructField("seeds", _LONGS)])
    body = {"body1": F.xxhash64("tokens"), "body2": F.xxhash64(F.lit(1), "tokens")}
    regions = cut(given.mapInArrow(_scan(known, stretch), kinds).withColumns(body))
    bodies = cut(regions.groupBy("body1", "body2").agg(F.first("tokens").alias("tokens"), F.first("seeds").alias("seeds")))

    salted = bodies.select("body1", "body2", F.pmod("body2", F.lit(SALTS)).alias("salt"), F.explode("seeds").alias("seed"))
    spread = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = salted.join(spread, ["seed", "salt"]).select("body1", "body2", "segment").distinct()
    both = pairs.join(bodies.select("body1", "body2", "tokens"), ["body1", "body2"]).join(parts, "segment")
    found = cut(both.select("body1", "body2", "item", "length", "tokens", "their_tokens").mapInArrow(_compare(stretch, agree), _FOUND))
    placed = regions.drop("tokens", "seeds").join(found, ["body1", "body2"])
    return placed.select(*carried, "item", "agreeing", "compared", (F.col("start") + F.col("low")).alias("first_token"), (F.col("start") + F.col("high")).alias("end_token"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(_row, key, n_items, item_ids, agreeing, compared): a row for each document with an overlap; the last two of the best stretch."""
    rows = numbered(docs.select(F.col(key).alias("_key"), F.col(how.pop("text", "text")).alias("text")))
    found = overlaps_with(rows, benchmark, **how)
    best = F.max(F.struct("agreeing", F.negate("compared").alias("c")))
    per_row = found.groupBy("_row", "_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), best.alias("_best"))
    return per_row.select("_row", F.col("_key").alias(key), F.size("item_ids").cast("long").alias("n_items"), "item_ids",
                          F.col("_best.agreeing").alias("agreeing"), F.negate("_best.c").alias("compared"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents without a verified overlap; columns as given."""
    rest, back = packed(docs)
    found = overlaps_with(numbered(docs.select(F.col(text).alias("text"))), benchmark, **how).select("_row").distinct()
    return numbered(docs.select(rest)).join(cut(found), "_row", "left_anti").select(*back.values())
