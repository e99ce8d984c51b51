import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from txflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_are_encoded_as_in_the_whole_text(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    rng = random.Random(5)
    parts = ["a", "B", "é", " ", " ", " ", "\n", "$", "!", "'", "1", "<|endoftext|>", "s", "'s", "\t", "中", "~", "-", "|", "<", "ed", "\u00a0", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(6_000)]
    coder = packing.WordCoder(PATH)
    for k in range(0, len(texts), 500):
        own = texts[k : k + 500]
        want = [x.ids for x in TOKENIZER.encode_batch(own, add_special_tokens=False)]
        assert [np.frombuffer(b, coder.width).tolist() for b in coder.encode(own)] == want


@pytest.mark.parametrize(("remembered", "together"), [(500, 50), (10, 3)])
def test_parts_are_put_together_from_lines_words_and_signs(monkeypatch, remembered, together):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    monkeypatch.setattr(packing, "JOINED", together)
    rng = random.Random(7)
    parts = ["a", "B", "é", "\n", "\n\n", "\r\n", "$", "!", "'s", "'", "1", "²", "×", "ö.", "a.\nBc", "Word,", "<|endoftext|>", "\u0301", "\u0345", "\x85", "中", "Ġ", "Ċ", "😀"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))) for _ in range(3_000)]
    coder = packing.WordCoder(PATH)
    for k in range(0, len(texts), 500):
        own = texts[k : k + 500]
        want = [x.ids for x in TOKENIZER.encode_batch(own, add_special_tokens=False)]
        assert [np.frombuffer(b, coder.width).tolist() for b in coder.encode(own)] == want


def test_new_parts_go_to_the_tokenizer_together():
    coder, given = packing.WordCoder(PATH), []
    encode = coder._encode
    coder._encode = lambda texts: given.extend(texts) or encode(texts)
    words = [f"Wörd{i}" for i in range(3_000)]
    for text in (" ".join(words), " ".join(w + "." for w in words), " ".join(f"{a}\n{b}" for a, b in zip(words[::2], words[1::2], strict=True))):
        assert np.frombuffer(coder.encode([text])[0], coder.width).tolist() == ids(text)[:-1]
    assert len(given) < 20 and sum(map(len, given)) < 3 * len(" ".join(words))  # each word twice: after a space and after a line end


@pytest.mark.parametrize("length", [2048, 64])
def test_pieces(odd, length):
    rows = odd.repartition(5).collect()
    pieces = packing.pack(odd, PATH, length=length).collect()
    total = sum(len(ids(r.text)) for r in rows)
    by_sequence = defaultdict(list)
    seen = Counter()
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(ids(r.text))
    for p in pieces:
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert p.length == len(own) > 0 and p.ids_crc32 == zlib.crc32(p.ids)
        assert any(own == w[p.start : p.start + p.length] and len(w) == p.doc_tokens for w in whole[p.doc_id])
        by_sequence[p.sequence_id].append((p.offset, p.length))
        seen[p.doc_id] += p.length
    assert seen == Counter({k: sum(map(len, v)) for k, v in whole.items()})
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for number, parts in by_sequence.items():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end == (length if number < len(by_sequence) - 1 else total - length * (len(by_sequence) - 1))


def test_sequences_and_boundaries(odd):
    pieces = packing.pack(odd, PATH, length=256)
    rows = packing.sequences(pieces, 256).orderBy("sequence_id").collect()
    total = sum(len(ids(r.text)) for r in odd.collect())
    assert sum(r.n_tokens for r in rows) == total and all(len(r.input_ids) == 256 for r in rows[:-1])
    assert len(rows[-1].input_ids) == packing.padded(rows[-1].n_tokens, 256)
    cut = {r.sequence_id: r.pieces for r in packing.boundary_records(pieces).collect()}
    assert cut == {k: n for k, n in Counter(p.sequence_id for p in pieces.collect()).items() if n > 1}
    assert packing.padded(1024) == 1024 and packing.padded(1000) == 2048


def test_empty(empty):
    assert packing.pack(empty, PATH).collect() == [] and packing.sequences(packing.pack(empty, PATH)).collect() == []
