"""SimHash near-duplicates, linked through a hierarchical index in Gray order.

Fingerprints within D bits share one of D + 1 segments exactly. So each distinct fingerprint enters
D + 1 indexes, the k-th of which rotates segment k to the front. An index is sorted by Gray rank, where
neighbours differ in few bits, and cut into blocks of fingerprints with the same front segment. A
block keeps the bits that all its members share as a masked pattern; the same is done for groups of
16 below it, and groups of those. A search goes down two trees at a time and drops a pair of
nodes as soon as their patterns differ in more than D bits on the shared masks: a child's mask holds
its parent's, so the differences add up on the way.

Blocks hold at most ``BLOCK`` fingerprints. Segments with more have several blocks; pairs of blocks
that the patterns do not exclude are joined, so no task ever holds more than two blocks. A block, or
pair, gives a spanning forest of its links instead of all of them: as many components, and at most
one edge for each member. Equal fingerprints are one node, so exact copies cost nothing.

Defined cases: a null text is empty; a text without words has fingerprint zero, linked like any other;
null ids do not count for the smallest id (null if there is no other); repeated rows and ids each get
a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import U64, filled, numbered, packed, slices
from txflow.llm.components import components
from txflow.session import cut

WIDTH = 3
SEED = 42
DISTANCE = 3
BLOCK = 4_096
FAN = 16
PAIRS = 1 << 15  # node pairs that are opened at a time
SHINGLES = 1 << 16  # hashes whose bits are unpacked at a time


def fingerprint(text: str, width: int = WIDTH) -> int:
    """64 bits, one for each bit that more than half of the shingle hashes have set."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only the six ASCII white spaces split
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    take = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, take, SHINGLES):
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[k : min(k + SHINGLES, take)], last[k : k + SHINGLES], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > take, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` without its text, and the fingerprint as a signed ``fp``."""
    rest = [c for c in docs.columns if c != text]
    df = docs.select(*rest, filled(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                fp = np.array([fingerprint(t, width) for t in b.column("_text").to_pylist()], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(fp)], names=[*rest, "fp"])

    return df.mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest), T.StructField("fp", T.LongType())]))


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, as a long that sorts like the unsigned number."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _turned(fp: Column, by: int) -> Column:
    """The word rotated to the left."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def _back(codes: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated to the right again, as signed numbers."""
    by = turn.astype(U64)
    out = np.where(by == 0, codes, (codes >> by) | (codes << ((U64(64) - by) & U64(63))))
    return out.view(np.int64)


def shared_bits(codes: np.ndarray) -> tuple[int, int]:
    """Mask and pattern of the bits that all codes have in common."""
    ones, zeros = np.bitwise_and.reduce(codes), np.bitwise_and.reduce(~codes)
    return int(ones | zeros), int(ones)


def _tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Masks and patterns by level, from the codes themselves up to a single node; FAN children each."""
    full = ~np.zeros(len(codes), U64)
    levels = [(full, codes)]
    ones, zeros = codes, ~codes
    while len(ones) > 1:
        at = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        levels.append((ones | zeros, ones))
    return levels


def near_pairs(a: np.ndarray, b: np.ndarray | None, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``distance`` bits, of two lists in Gray order or inside one, some at a time."""
    left = _tree(a)
    right = left if b is None else _tree(b)
    height = max(len(left), len(right))
    left = [*left, *[left[-1]] * (height - len(left))]
    right = [*right, *[right[-1]] * (height - len(right))]
    stack = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        (mask_a, bits_a), (mask_b, bits_b) = left[level], right[level]
        alive = np.bitwise_count((bits_a[i] ^ bits_b[j]) & mask_a[i] & mask_b[j]) <= distance
        i, j = i[alive], j[alive]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        for k in range(0, len(i), max(1, PAIRS // FAN**2)):
            x, y = (_children(n[k : k + max(1, PAIRS // FAN**2)], levels, level) for n, levels in ((i, left), (j, right)))
            x, y = np.repeat(x, y.shape[1], axis=1).ravel(), np.tile(y, (1, x.shape[1])).ravel()
            good = (x >= 0) & (y >= 0) if b is not None else (x >= 0) & (y >= x)
            stack.append((level - 1, x[good], y[good]))


def _children(nodes: np.ndarray, levels: list, level: int) -> np.ndarray:
    """Child numbers, -1 where there is none; a level repeated on top has one child."""
    below = len(levels[level - 1][1])
    if levels[level] is levels[level - 1]:
        return nodes[:, None]
    out = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(out < below, out, -1)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) with the same components as all pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root != root[root]).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


_BLOCK = T.StructType([
    T.StructField("turn", T.IntegerType()), T.StructField("front", T.LongType()), T.StructField("block", T.LongType()),
    T.StructField("mask", T.LongType()), T.StructField("pattern", T.LongType()), T.StructField("codes", T.BinaryType()),
])


def _cut_blocks(size: int, distance: int):
    """Sorted codes to blocks; a segment with one code inside a partition has no partner and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        first, opened = True, False  # no segment is finished yet; blocks of the open segment are out already

        def emit(turn, front, code, final) -> tuple[list, int]:
            """Rows of the finished segments, and where the unfinished one begins."""
            nonlocal number, first, opened
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(front) != 0) | (np.diff(turn) != 0))))
            ends = np.append(starts[1:], len(front))
            rows = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                last = e == len(front)
                if last and not final:
                    whole = s + (e - s - 1) // size * size  # all but the last block of the open segment
                    e = whole
                if e - s > 1 or (e > s and (first or opened or (last and final))):
                    for k in range(s, e, size):
                        mask, pattern = shared_bits(code[k : min(k + size, e)])
                        rows.append((int(turn[s]), int(front[s]), number, mask, pattern, code[k : min(k + size, e)].tobytes()))
                        number += 1
                if last and not final:
                    opened |= e > s
                    return rows, e
                first = opened = False
            return rows, len(front)

        for b in batches:
            new = (b.column("turn").to_numpy(), b.column("front").to_numpy(), b.column("code").to_numpy().view(U64))
            data = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
            if not len(data[0]):
                continue
            rows, at = emit(*data, False)
            kept = tuple(x[at:] for x in data)
            yield _blocks(rows)
        if kept is not None and len(kept[0]):
            yield _blocks(emit(*kept, True)[0])

    return run


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    signed = lambda k: pa.array(np.array([r[k] for r in rows], U64).view(np.int64))
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
        signed(3), signed(4), pa.array([r[5] for r in rows], pa.binary())], names=_BLOCK.names)


def _links(distance: int):
    """Spanning forests of the links inside a block (codes) or between two (codes, others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, turns = [], [], []
            others = b.column("others").to_pylist() if "others" in b.schema.names else [None] * b.num_rows
            for turn, raw, other in zip(b.column("turn").to_pylist(), b.column("codes").to_pylist(), others, strict=True):
                one = np.frombuffer(raw, U64)
                two = None if other is None else np.frombuffer(other, U64)
                codes = one if two is None else np.concatenate((one, two))
                shift = 0 if two is None else len(one)
                at, root = _forest(len(codes), ((i, j + shift) for i, j in near_pairs(one, two, distance)))
                if len(at):
                    u.append(codes[at])
                    v.append(codes[root])
                    turns.append(np.full(len(at), turn))
            if u:
                turn = np.concatenate(turns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_back(np.concatenate(u), turn)), pa.array(_back(np.concatenate(v), turn))], names=["u", "v"])

    return run


def near_edges(codes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that connect whatever lies within ``distance`` bits."""
    width = 64 // (distance + 1)
    turns = F.array(*[F.struct(F.lit(k * width).alias("turn"), _turned(F.col("fp"), k * width).alias("code")) for k in range(distance + 1)])
    each = codes.select(F.inline(turns)).withColumns({
        "front": F.shiftrightunsigned("code", 64 - width), "rank": gray_rank(F.col("code"))})
    ordered = each.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    blocks = cut(ordered.select("turn", "front", "code").mapInArrow(_cut_blocks(block, distance), _BLOCK))
    inside = blocks.select("turn", "codes").mapInArrow(_links(distance), "u long, v long")
    large = blocks.groupBy("turn", "front").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    nodes = blocks.select("turn", "front", "block", "mask", "pattern").join(large, ["turn", "front"])
    a, b = nodes.alias("a"), nodes.alias("b")
    apart = F.bit_count(F.col("a.pattern").bitwiseXOR(F.col("b.pattern")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask")))
    pairs = a.join(b, (F.col("a.turn") == F.col("b.turn")) & (F.col("a.front") == F.col("b.front"))
                   & (F.col("a.block") < F.col("b.block")) & (apart <= distance)).select(
        F.col("a.turn").alias("turn"), F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    held = blocks.select("block", "codes")
    both = pairs.join(held.select(F.col("block").alias("one"), "codes"), "one").join(
        held.select(F.col("block").alias("two"), F.col("codes").alias("others")), "two")
    between = both.select("turn", "codes", "others").mapInArrow(_links(distance), "u long, v long")
    return inside.unionByName(between)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """(_row, key, fp, root, component_id): the smallest id, and fingerprint, that a chain of links reaches."""
    marked = cut(fingerprints(numbered(docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))), width))
    nodes = cut(marked.groupBy("fp").agg(F.min("_key").alias("least")))
    linked = components(near_edges(nodes.select("fp"), distance))
    named = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = named.select("fp", "root").join(roots, "root")
    return marked.join(table, "fp").withColumnRenamed("_key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row of each class: the one with the smallest id, the first of equal ids. Columns as given."""
    found = classes(docs, key, text, width, distance)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_row").alias("row"))
    best = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row").alias("_row"))
    rest, back = packed(docs)
    return numbered(docs.select(rest)).join(best, "_row", "left_semi").select(*back.values())
