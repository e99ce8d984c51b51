"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else. Each such string
is the head of a suffix, so equal heads are neighbours among the sorted suffixes. Sorting the suffixes
of a whole corpus would move each byte many times; most of that is saved first, and exactly:

1. Anchors. Each window of ``length`` bytes picks the place with the smallest hash among its ``GRAM``-byte
   grams. Equal windows pick the same place in themselves. Windows in a row that pick the same place
   are a *run*, and only runs are shuffled, by the hash of their gram. A run whose gram nothing else
   has is done with; runs with equal bytes (polynomial hash of the gram and XXH3 of the run, 128 bits
   from two hash families) are repeats throughout.
2. Suffix sort. What is left are runs that share a gram but differ as a whole: the rims of
   repeats. Their bytes are fetched, and the suffixes that start at their windows are sorted by
   a mergesort. Two suffixes are compared by prefix polynomial hashes: a binary search over hash equality
   finds the length they have in common, then one byte decides. Neighbours that agree on ``length``
   bytes are verified byte by byte; should a hash have lied, the suffixes concerned are grouped by their bytes.
3. The spans found are joined per document and cut out.

Grams that many runs share (common lines with different surroundings) are dealt out window by
window, by the hash of the window, so that no task needs all runs of a gram. Equal windows meet there:
each task ahead of the shuffle sends two of them at most (as long as its table of windows lasts), and they are
sorted by their bytes and compared with their neighbours, so a passage in any number of documents takes constant memory.

Defined cases: a null text is empty; matches never cross documents; repeated rows are documents of their own,
so each of them repeats the other; texts shorter than ``length`` lose nothing; an empty table gives an
empty table; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import BASE, U64, PrefixHash, filled, mix, numbered, packed, slices
from txflow.session import cut

LENGTH = 200
GRAM = 64
BUFFER = 1 << 18  # bytes that are hashed at a time
RUNS = 2_048  # runs of one gram that a task sorts together
SORTED = 1 << 20  # bytes of runs that are sorted at a time
SEEN = 1 << 16  # distinct dealt windows that a task remembers

_PLACE = U64((1 << 20) - 1)


# --- 1. anchors --------------------------------------------------------------------------------

def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row: the least of a block's tail and of the next one's head."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, ~U64(0), U64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows in documents that lie one after another in ``data``: document, first and last window, gram hash."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    grams = mix(PrefixHash(data).every(gram))
    # The place breaks ties among equal grams, leftmost first, in every copy alike.
    pick = _sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=U64), length - gram + 1)
    borders = [np.flatnonzero(pick[1:] != pick[:-1]) + 1, starts, np.maximum(ends - length + 1, 0)]
    first = np.unique(np.concatenate([np.zeros(1, np.int64), *borders]))
    first = first[first < len(pick)]
    last = np.append(first[1:], len(pick)) - 1
    doc = np.searchsorted(starts, first, "right") - 1
    inside = (doc >= 0) & (first >= starts[doc]) & (first + length <= ends[doc])
    first, last, doc = first[inside], last[inside], doc[inside]
    return doc, first, last, grams[(pick[first] & _PLACE).astype(np.int64)]


def _buffers(rows: list[int], texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Texts put together up to BUFFER bytes, long ones in parts that overlap: bytes, rows, offsets in the text, starts in the buffer."""
    held, size, who, offsets, at = [], 0, [], [], []
    for row, text in zip(rows, texts, strict=True):
        for offset in range(0, max(1, len(text) - length + 1), BUFFER):
            part = text[offset : offset + BUFFER + length - 1]
            if size + len(part) > 2 * BUFFER and held:
                yield b"".join(held), who, offsets, at
                held, size, who, offsets, at = [], 0, [], [], []
            at.append(size)
            who.append(row)
            offsets.append(offset)
            held.append(part)
            size += len(part)
    if held:
        yield b"".join(held), who, offsets, at


def _find_runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows, texts = b.column("_row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
                long = [i for i, t in enumerate(texts) if len(t) >= length]
                parts = []
                for data, who, offsets, at in _buffers([rows[i] for i in long], [texts[i] for i in long], length):
                    starts = np.array(at, np.int64)
                    doc, first, last, key = runs_of(np.frombuffer(data, np.uint8), starts, np.append(starts[1:], len(data)), length, gram)
                    digest = xxhash.xxh3_64_intdigest
                    body = [digest(data[a:z]) for a, z in zip(first.tolist(), (last + length).tolist(), strict=True)]
                    low = first - starts[doc] + np.array(offsets, np.int64)[doc]
                    parts.append((key.view(np.int64), np.array(body, U64).view(np.int64), np.array(who, np.int64)[doc], low, last - first + 1))
                if parts:
                    yield _gathered(*(np.concatenate(x) for x in zip(*parts, strict=True)), length)

    return run


_RUN = "spans boolean, gram long, body long, _row long, low long, windows int, many boolean"


def _gathered(gram: np.ndarray, body: np.ndarray, row: np.ndarray, low: np.ndarray, windows: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs ahead of the shuffle: equal ones of a batch become one, marked ``many``, and the places of all of them become joined spans.

    Spans have nothing left to meet, so they are dealt out by their document. A gram of which a text
    has thousands (a line of one letter) leaves each batch as one run for each body.
    """
    order = np.lexsort((low, row, body, gram))
    gram, body, row, low, windows = (x[order] for x in (gram, body, row, low, windows))
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (body[1:] != body[:-1]))) if len(gram) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(gram)))
    many = np.repeat(size > 1, size)
    at = np.flatnonzero(many)
    at = at[np.lexsort((low[at], row[at]))]
    r, start, end = row[at], low[at], low[at] + windows[at]
    # Windows of a document in a row: the ends only grow, as runs of one document do not overlap.
    first = np.concatenate(([True], (r[1:] != r[:-1]) | (start[1:] > end[:-1]))) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(first)
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    spread = mix(r[head].astype(U64)).view(np.int64)
    zero = np.zeros(len(head), np.int64)
    columns = [
        (np.zeros(int(new.sum()), bool), np.ones(len(head), bool)), (gram[new], spread), (body[new], zero), (row[new], r[head]), (low[new], start[head]),
        (windows[new].astype(np.int32), (end[tail] - start[head]).astype(np.int32)), (many[new], np.ones(len(head), bool)),
    ]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["spans", "gram", "body", "_row", "low", "windows", "many"])


_SPLIT = "_row long, low long, windows int, gram long, rim boolean, repeated boolean"


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (gram, body): the repeated ones, and one of each body where bodies differ.

    Works on neighbours only: a row is repeated if the one before or after is equal, and a body has
    company if another body of its gram comes before its first or after its last row. So a gram
    of any size takes constant memory; one row waits for the next batch.
    """
    held: dict[str, np.ndarray] | None = None
    before = None  # gram and body of the row ahead of ``held``, and whether its body has company so far
    company = False
    names = ("gram", "body", "_row", "low", "windows", "many")

    def part(rows: dict[str, np.ndarray], after) -> pa.RecordBatch | None:
        nonlocal before, company
        gram, body, n = rows["gram"], rows["body"], len(rows["gram"])
        if not n:
            return None
        same_gram = np.empty(n + 1, bool)
        same_body = np.empty(n + 1, bool)
        same_gram[1:n], same_body[1:n] = gram[1:] == gram[:-1], body[1:] == body[:-1]
        same_gram[0], same_body[0] = (False, False) if before is None else (gram[0] == before[0], body[0] == before[1])
        same_gram[n], same_body[n] = (False, False) if after is None else (gram[-1] == after[0], body[-1] == after[1])
        same_body &= same_gram
        repeated = same_body[:-1] | same_body[1:] | rows["many"]
        begins, ends = ~same_body[:-1], ~same_body[1:]
        group = np.cumsum(begins)
        met = np.concatenate(([company], same_gram[:-1][begins]))  # company ahead of each body
        rim = ends & (met[group] | same_gram[1:])
        before, company = (gram[-1], body[-1]), bool(met[group[-1]])
        keep = repeated | rim
        out = [rows[c][keep] for c in ("_row", "low", "windows", "gram")]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, rim[keep], repeated[keep])],
                                          names=["_row", "low", "windows", "gram", "rim", "repeated"])

    for b in batches:
        done = b.filter(b.column("spans"))
        if done.num_rows:
            no, yes = pa.array(np.zeros(done.num_rows, bool)), pa.array(np.ones(done.num_rows, bool))
            yield pa.RecordBatch.from_arrays([*(done.column(c) for c in ("_row", "low", "windows", "gram")), no, yes],
                                             names=["_row", "low", "windows", "gram", "rim", "repeated"])
            b = b.filter(pc.invert(b.column("spans")))
        rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            rows = {c: np.concatenate((held[c], rows[c])) for c in names}
        if not len(rows["gram"]):
            continue
        held = {c: x[-1:] for c, x in rows.items()}
        found = part({c: x[:-1] for c, x in rows.items()}, (held["gram"][0], held["body"][0]))
        if found is not None:
            yield found
    if held is not None:
        yield part(held, None)


# --- 2. suffix sort ----------------------------------------------------------------------------

def common_length(hashes: PrefixHash, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that the suffixes at i and j have in common, at most ``limit``, by binary search over hash equality."""
    found = np.zeros(len(i), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        ahead = np.minimum(found + step, limit)
        equal = hashes.of(i, i + ahead) == hashes.of(j, j + ahead)
        found = np.where(equal, ahead, found)
        step >>= 1
    return found


def _less(data: np.ndarray, hashes: PrefixHash, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    n = common_length(hashes, i, j, limit)
    inside = np.minimum(n, limit - 1)
    return (n < limit) & (data[i + inside] < data[j + inside])


def suffix_order(data: np.ndarray, hashes: PrefixHash, starts: np.ndarray, limit: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` sorted by their suffixes' first ``limit`` bytes, and the number of each one's group of equal first 8 bytes.

    Groups of equal first bytes are formed first; inside them runs of doubling width are merged, all merges
    of a width at once: an element's place is its own rank plus its rank in the other run, found by
    binary search with hash comparisons.
    """
    head = np.zeros(len(starts), U64)
    for k in range(8):
        head = (head << U64(8)) | data[starts + k].astype(U64)
    order = np.argsort(head, kind="stable")
    starts, head = starts[order], head[order]
    group = np.cumsum(np.concatenate(([0], head[1:] != head[:-1]))) if len(starts) else np.zeros(0, np.int64)
    first = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")
    width = 1
    while len(starts) and width < (end - first).max():
        at = np.arange(len(starts))
        run = (at - first) // width
        left = run % 2 == 0
        low = np.where(left, first + (run + 1) * width, first + (run - 1) * width)
        low, high = np.minimum(low, end), np.minimum(low + width, end)
        base = low.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            # From a left run, elements of the right one go ahead only if they are less.
            other, own = starts[mid], starts[live]
            ahead = np.where(left[live], _less(data, hashes, other, own, limit), ~_less(data, hashes, own, other, limit))
            low[live] = np.where(ahead, mid + 1, low[live])
            high[live] = np.where(ahead, high[live], mid)
            live = live[low[live] < high[live]]
        pair = first + run // 2 * 2 * width
        inside = at - (first + run * width)
        place = pair + inside + (low - base)
        merged = np.empty_like(starts)
        merged[place] = starts
        starts = merged
        width *= 2
    return starts, group


def repeated_heads(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The starts whose first ``length`` bytes also begin at another start."""
    hashes = PrefixHash(data)
    order, group = suffix_order(data, hashes, starts, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[1:] == group[:-1])
    equal = near[common_length(hashes, a[near], b[near], length) == length]
    lied = np.zeros(0, np.int64)
    for k in range(0, len(equal), 1 << 14):  # verified byte by byte
        at = equal[k : k + (1 << 14)]
        view = np.arange(length)
        same = (data[a[at][:, None] + view] == data[b[at][:, None] + view]).all(axis=1)
        lied = np.append(lied, at[~same])
    if len(lied):  # the order cannot be trusted in these groups: compare their bytes
        doubtful = np.isin(group, group[lied])
        heads: dict[bytes, list[int]] = {}
        for s in order[doubtful].tolist():
            heads.setdefault(data[s : s + length].tobytes(), []).append(s)
        sure = equal[~doubtful[equal]]
        again = [s for same in heads.values() if len(same) > 1 for s in same]
        return np.unique(np.concatenate([a[sure], b[sure], np.array(again, np.int64)]))
    return np.unique(np.concatenate([a[equal], b[equal]]))


_PIECE = "gram long, bucket long, _row long, low long, high long, repeated boolean, dealt boolean, bytes binary"


def _fetch(length: int, seen: int = SEEN):
    """Bytes of the rims of each document; single windows where the gram is dealt out.

    A task sends an equal window twice, which is enough to mark whatever equals it; further ones are repeats for sure and
    leave as joined spans without bytes. When the table of windows that were sent is full, those that were sent twice
    stay for another turn, so that windows seen once do not drive them out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        older: set[bytes] = set()
        for whole in batches:
            for b in slices(whole, "text"):
                out = []
                for row, text, rims in zip(b.column("_row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("rims").to_pylist(), strict=True):
                    for r in rims:
                        low, n = r["low"], r["windows"]
                        if r["deal"] == 1:
                            out.append((r["gram"], 0, row, low, low + n + length - 1, r["repeated"], False, text[low : low + n + length - 1]))
                            continue
                        spread, span = row * BASE % (1 << 63), None
                        for k in range(low, low + n):
                            head = text[k : k + length]
                            times = sent.get(head, 0) or 2 * (head in older)
                            if times == 2:
                                sent[head] = 2
                                if not r["repeated"]:  # the others are out as a whole already
                                    if span is not None and span[1] == k + length - 1:
                                        span[1] = k + length
                                    else:
                                        if span is not None:
                                            out.append((spread, -1, row, *span, False, True, None))
                                        span = [k, k + length]
                                continue
                            sent[head] = times + 1
                            out.append((r["gram"], xxhash.xxh3_64_intdigest(head) % r["deal"], row, k, k + length, r["repeated"], True, head))
                        if span is not None:
                            out.append((spread, -1, row, *span, False, True, None))
                        if len(sent) >= seen:  # a run adds few
                            sent, older = {}, {w for w, times in sent.items() if times == 2}
                kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)],
                                                 names=["gram", "bucket", "_row", "low", "high", "repeated", "dealt", "bytes"])

    return run


def _equal_windows(rows: pa.RecordBatch, last: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Spans of the dealt windows that equal a neighbour, byte by byte; ``last`` is the window ahead and whether its span is out."""
    out = []
    for gram, row, low, high, repeated, head in zip(*(rows.column(c).to_pylist() for c in ("gram", "_row", "low", "high", "repeated", "bytes")), strict=True):
        same = last is not None and last[0] == gram and last[1] == head
        if same and not last[3]:
            out.append(last[2])
        if same and not repeated:
            out.append((row, low, high))
        last = (gram, head, (row, low, high), same or repeated)
    return out, last


def _sort_rims(length: int):
    """Spans of the repeated windows among rims sorted by gram and bucket, whole grams at a time.

    Dealt windows come sorted by their bytes and need only their neighbours, however many are equal.
    """

    def solve(rows: list[dict]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        sizes = np.array([len(r["bytes"]) for r in rows], np.int64)
        base = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), windows)
        starts = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + base[owner]
        hit = repeated_heads(data, starts, length)
        owner = np.searchsorted(base, hit, "right") - 1
        open_rows = ~np.array([r["repeated"] for r in rows], bool)  # the others are out as a whole already
        hit, owner = hit[open_rows[owner]], owner[open_rows[owner]]
        new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(owner) != 0))) if len(hit) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1 if len(first) else first
        low = np.array([r["low"] for r in rows], np.int64)
        who = owner[first]
        return pa.RecordBatch.from_arrays([
            pa.array(np.array([r["_row"] for r in rows], np.int64)[who]), pa.array(hit[first] - base[who] + low[who]),
            pa.array(hit[last] - base[who] + low[who] + length)], names=["_row", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key, last = [], 0, None, None
        for b in batches:
            dealt = b.column("dealt")
            done = b.filter(pc.is_null(b.column("bytes")))
            if done.num_rows:
                yield done.select(["_row", "low", "high"])
            spans, last = _equal_windows(b.filter(pc.and_(dealt, pc.is_valid(b.column("bytes")))), last)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in spans], pa.int64()) for k in range(3)], names=["_row", "low", "high"])
            for r in b.filter(pc.invert(dealt)).to_pylist():
                new = r["gram"]
                if new != key and size > SORTED:
                    yield solve(rows)
                    rows, size = [], 0
                key = new
                rows.append(r)
                size += len(r["bytes"])
        if rows:
            yield solve(rows)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, runs: int = RUNS) -> DataFrame:
    """(_row, low, high): byte spans whose bytes go, of ``docs`` with ``_row`` and ``text``; spans may overlap."""
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 bytes at least and is no longer than the passage")
    found = docs.select("_row", "text").mapInArrow(_find_runs(length, gram), _RUN)
    ordered = found.repartition("gram").sortWithinPartitions("spans", "gram", "body", "_row", "low")
    split = cut(ordered.mapInArrow(_split_runs, _SPLIT))
    whole = split.filter("repeated").select("_row", "low", (F.col("low") + F.col("windows") + length - 1).alias("high"))
    rims = split.filter("rim").drop("rim")
    many = rims.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > runs)
    deal = F.coalesce(F.ceil(F.col("n") / runs) * (length - gram + 1), F.lit(1)).cast("long")
    dealt = rims.join(many, "gram", "left").withColumn("deal", deal).drop("n")
    fields = F.struct("gram", "low", "windows", "repeated", "deal")
    wanted = dealt.groupBy("_row").agg(F.collect_list(fields).alias("rims"))
    pieces = docs.select("_row", "text").join(wanted, "_row").mapInArrow(
        _fetch(length), _PIECE)
    head = F.when(F.col("dealt"), F.col("bytes"))
    rim_spans = pieces.repartition("gram", "bucket").sortWithinPartitions("gram", "bucket", head).mapInArrow(
        _sort_rims(length), "_row long, low long, high long")
    return whole.unionByName(rim_spans)


# --- 3. removal --------------------------------------------------------------------------------

def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


_REMOVED = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()),
])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                out = {n: [] for n in _REMOVED.names}
                for data, spans in zip(b.column("_text").cast(pa.binary()).to_pylist(), b.column("_spans").to_pylist(), strict=True):
                    gone = merged([(s["low"], s["high"]) for s in spans or ()])
                    edges = [0, *(x for s in gone for x in s), len(data)]
                    kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(len(data) - len(kept))
                    out["n_spans"].append(len(gone))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept_text"].append(kept.decode(errors="ignore") if with_text else None)
                own = [pa.array(out[f.name], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _REMOVED]
                yield pa.RecordBatch.from_arrays([b.column("_rest"), *own], names=["_rest", *_REMOVED.names])

    return run


def _removed(docs: DataFrame, rest: Column, text: str, length: int, gram: int, with_text: bool) -> DataFrame:
    """(_rest, n_bytes, n_removed, n_spans, kept_sha256, kept_text)."""
    rows = numbered(docs.select(rest, filled(text).alias("_text")))
    spans = repeated_spans(rows.select("_row", F.col("_text").alias("text")), length, gram)
    by_row = spans.groupBy("_row").agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    joined = rows.join(by_row, "_row", "left").select("_rest", "_text", "_spans")
    return joined.mapInArrow(_remove(with_text), T.StructType([joined.schema["_rest"], *_REMOVED.fields]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row.

    The hash is of the remaining bytes; the kept text also drops bytes of a character that a removed span cuts.
    """
    rest, back = packed(docs.select(key))
    return _removed(docs, rest, text, length, gram, with_text).select(back[key], *_REMOVED.names)


def cut_from(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with their repeats cut out; columns and untouched texts as given. Documents that lose all their bytes go."""
    rest, back = packed(docs, text)
    rest = F.struct(rest.alias("given"), F.col(text).isNull().alias("none")).alias("_rest")
    found = _removed(docs, rest, text, length, gram, True)
    kept = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    new = F.when(~F.col("_none"), F.col("kept_text")).alias(text)
    kept = kept.select(F.col("_rest.none").alias("_none"), F.col("_rest.given").alias("_rest"), "kept_text")
    return kept.select(*(new if c == text else back[c] for c in docs.columns))
