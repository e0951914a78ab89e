"""Word, shingle and minimum hashes against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from outletry.llm import hashing
from outletry.llm.hashing import MinHash, shingles_of, sketch, sorted_groups, text_slices, words_of

WORD = re.compile("[^\x20\x09-\x0d]+")
UP = {c: c + 32 for c in range(65, 91)}


def plain_shingles(text):
    words = WORD.findall((text or "").translate(UP))
    return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def hashed(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = []
    for _, _, raw, edges in text_slices(batch):
        shingles, counts = shingles_of(words_of(raw, edges))
        ends = np.cumsum(counts)
        out += [list(shingles[e - c : e]) for e, c in zip(ends, counts)]
    return out


TEXTS = [
    None, "", " \n\t", "a", "A b", "a b c d e", "A  b\tc\nd e", "a b c d e f g", "É é Ü x y z \x1f q", "a" * 50,
    "x y z w", "a b c d e", "\u3000a b", "ab c", "a bc",
]


@pytest.mark.parametrize("piece", [8, 64, 1 << 20])
def test_shingles_are_equal_exactly_where_words_are(monkeypatch, piece):
    monkeypatch.setattr(hashing, "SLICE_BYTES", piece)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcde") * rng.randint(1, 4) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = hashed(texts)
    seen = {}
    for text, hashes in zip(texts, got, strict=True):
        want = plain_shingles(text)
        assert len(want) == len(hashes)
        for shingle, value in zip(want, hashes):
            assert seen.setdefault(shingle, value) == value
    assert len(set(seen.values())) == len(seen)


def test_minima_and_sketch_estimate_similarity():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    errors, bit_errors = [], []
    for share in (0.005, 0.01, 0.03) * 15:
        base = [rng.choice(words) for _ in range(300)]
        other = [w if rng.random() > share else rng.choice(words) for w in base]
        texts = [" ".join(base), " ".join(other)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        _, _, raw, edges = next(text_slices(batch))
        shingles, counts = shingles_of(words_of(raw, edges))
        minima = MinHash(128)(shingles, counts)
        a, b = (set(plain_shingles(t)) for t in texts)
        true = len(a & b) / len(a | b)
        errors.append((minima[0] == minima[1]).mean() - true)
        differing = sum(bin((int(x[0]) ^ int(x[1])) & (2**64 - 1)).count("1") for x in sketch(minima))
        bit_errors.append(1 - 2 * differing / 128 - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert abs(np.mean(bit_errors)) < 0.03 and np.std(bit_errors) < 0.1


def test_sorted_groups_never_split_a_group():
    keys = sorted(random.Random(3).choices(range(20), k=200))
    table = pa.table({"k": pa.array(keys), "v": pa.array(range(200))})
    tables = list(sorted_groups(table.to_batches(max_chunksize=7), ["k"]))
    assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(200))
    seen = set()
    for t in tables:
        own = set(t.column("k").to_pylist())
        assert not own & seen
        seen |= own
