"""Language identification by compression.

Each language has a zstandard raw-content dictionary: excerpts of its training texts. A text is
reduced to lower-case letters and cut into blocks, each block is compressed with every dictionary, and the language with the smallest
total wins. Blocks are short, so that the dictionary, not the text's own past, decides in long texts.
The margin is the share by which the runner-up is larger; narrow ones are rejected.

The dictionaries come from a bounded sample (``ROWS`` texts a language, an excerpt of ``EXCERPT``
characters each). Equal texts count once. Prediction covers whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and not accepted; equal sizes go
to the language with more training texts, then to the smaller name; without any training text every
prediction is ``und``; repeated rows and ids each get a row; other columns are kept.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import with_struct

ROWS = 600
EXCERPT = 600
BLOCK = 2_048
LEVEL = 3
MARGIN = 0.004
TEMPERATURE = 3.0  # bytes by which a size may exceed the best one before its weight falls to 1/e

VERDICT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
])

_OTHER = re.compile(r"[\W\d_]+")

Dictionaries = tuple[tuple[str, bytes], ...]


def fit(train: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS, excerpt: int = EXCERPT) -> Dictionaries:
    """(language, dictionary), most frequent language first; rows without text or language are left out."""
    usable = train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).collect()
    if not sizes:
        return ()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, 1.2 * rows / r["texts"]) * (1 << 30)))])
    chosen = usable.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < share[F.col("lang")])
    # An excerpt from a place that the text's hash names.
    start = F.pmod(F.shiftright("h", 30), F.greatest(F.lit(1), F.length("text") - excerpt + 1)) + 1
    chosen = chosen.groupBy("lang", "h").agg(F.first(F.substring(F.col("text"), start.cast("int"), F.lit(excerpt))).alias("part"))
    parts: dict[str, list[str]] = {r["lang"]: [] for r in sizes}
    for r in chosen.orderBy("h").limit(2 * rows * len(sizes)).collect():
        parts[r["lang"]].append(r["part"])
    order = sorted(sizes, key=lambda r: (-r["n"], r["lang"]))
    return tuple((r["lang"], letters("\n".join(parts[r["lang"]])).encode()) for r in order if parts[r["lang"]])


def letters(text: str) -> str:
    """Lower-case words of letters, one space between them: what languages differ in."""
    return _OTHER.sub(" ", text.lower())


@cache
def _compressors(dictionaries: Dictionaries) -> list:
    import zstandard

    out = []
    for _, content in dictionaries:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
    return out


def classify(texts: list[str | None], dictionaries: Dictionaries, margin: float = MARGIN) -> list[list]:
    """Language, score, margin and acceptance of each text, as four lists."""
    found = []
    coders = _compressors(dictionaries)
    for text in texts:
        if not coders or text is None or not any(map(str.isalpha, text)):
            found.append(("und", 0.0, 0.0, False))
            continue
        data = letters(text).encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
        best, *others = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        gap = (sizes[others[0]] - sizes[best]) / sizes[others[0]] if others else 1.0
        score = 1 / sum(math.exp((sizes[best] - s) / TEMPERATURE) for s in sizes)
        found.append((dictionaries[best][0], score, gap, gap >= margin))
    return [list(c) for c in zip(*found, strict=True)] if found else [[], [], [], []]


def identify(docs: DataFrame, dictionaries: Dictionaries, out: str = "language", margin: float = MARGIN) -> DataFrame:
    """``docs`` with a struct ``out``: lang, score, margin, accepted."""
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by ROWS, EXCERPT and the number of languages
    return with_struct(docs, out, VERDICT, lambda texts: classify(texts, known.value, margin))


def accepted(out: str = "language") -> Column:
    return F.col(f"{out}.accepted")
