import random
import tracemalloc
from itertools import combinations_with_replacement

import numpy as np
import xxhash

from claimweave.llm import simhash as sh

from .conftest import lower, words


def fingerprint(text):
    found = words(lower(text))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 3]).encode(), seed=42) for i in range(max(1, len(found) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    """Smallest id by component, over all pairs of prints."""
    distinct, which = np.unique(np.array(prints, np.uint64), return_inverse=True)
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ distinct[i]) <= 2):
            parent[find(i + 1 + j)] = find(i)
    least = {}
    for own, i in zip(ids, which, strict=True):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return [least.get(find(i)) for i in which]


def test_masks_cover_every_pair_of_bits():
    masks = [m % (1 << 64) for m in sh.covering_masks()]
    assert len(masks) == 7 and all(30 <= m.bit_count() <= 40 for m in masks)
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i, j in combinations_with_replacement(range(64), 2))


def test_fingerprints(make_docs, odd_rows):
    texts = [t for _, t in odd_rows] + ["A b", "x y z", "x y z w", "É é A", "a\x0bb\x1cc d"]
    assert [sh.fingerprint((t or "").encode()) for t in texts] == [fingerprint(t) for t in texts]


def test_chains_and_crowds(spark):
    chance, prints = random.Random(5), set()
    for _ in range(30):
        own = chance.getrandbits(64)
        for _ in range(chance.choice([1, 2, 3, 30, 90])):
            prints.add(own)
            for _ in range(chance.choice([1, 1, 2, 3])):
                own ^= 1 << chance.randrange(64)
    centre = chance.getrandbits(64)
    prints = sorted(prints | {centre} | {centre ^ 1 << i for i in range(64)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, least long")
    found = {r.fp: r.component_id for r in sh.components(distinct).collect()}
    assert [found[p] for p in signed] == components(range(len(prints)), prints)


def test_radius_one(spark):
    rows = [(0b0, 0), (0b1, 1), (0b11, 2), (0b1100000, 3), (1 << 40, 4), (-1 << 63, 5)]
    found = {r.fp: r.component_id for r in sh.components(spark.createDataFrame(rows, "fp long, least long"), radius=1).collect()}
    assert found == {0: 0, 1: 0, 3: 0, 96: 3, 1 << 40: 0, -1 << 63: 0}


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    found = sh.near_duplicates(docs).collect()
    expected = components([i for i, _ in odd_rows], [fingerprint(t) for _, t in odd_rows])
    rows = sorted((str(i), f"{fingerprint(t):016x}", str(c)) for (i, t), c in zip(odd_rows, expected, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == rows
    assert sh.near_duplicates(make_docs([])).collect() == []
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    # 1 and 2 are copies, 3 to 5 and the null text have no words; 7 repeats; 8 has two texts of two components, which both stay.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "6", "7", "8", "8", "9", "None"])


def test_one_row_of_each_component_stays(make_docs):
    """An id in two components, and near copies without ids."""
    base = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"other{i}" for i in range(400))
    docs = make_docs([(1, base), (2, base + " end"), (1, "another text"), (None, other), (None, other + " x"), (3, "another text"), (None, base)])
    groups = {r.component for r in sh._classified(docs, 2).collect()}
    kept = sh.keep_one(docs).collect()
    assert len(kept) == len(groups) == 3 and {(r.doc_id, r.text) for r in kept} >= {(1, base), (1, "another text")}


def test_buckets_of_every_size(spark, monkeypatch):
    chance = random.Random(8)
    prints = {chance.getrandbits(64) for _ in range(20)}
    for own in list(prints):
        for _ in range(chance.choice([1, 5, 25])):
            own ^= 1 << chance.randrange(64)
            prints.add(own)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, least long")
    for most in (2, 4, 32):
        monkeypatch.setattr(sh, "BUCKET", most)
        found = {r.fp: r.component_id for r in sh.components(distinct).collect()}
        assert [found[p] for p in signed] == components(range(len(prints)), prints)


def test_long_texts_in_pieces(monkeypatch):
    texts = [b"one two three four five", b"a  b", b"   ", b"", b"x" * 50, b"x" * 30 + b" y " + b"z" * 30 + b"\n\tq", "é ß 東京 w".encode() * 9]
    whole = [sh.fingerprint(t) for t in texts]
    for size in (1, 3, 10):
        monkeypatch.setattr(sh, "_PIECE_BYTES", size)
        assert [sh.fingerprint(t) for t in texts] == whole == [fingerprint(t.decode()) for t in texts]


def test_memory_of_a_long_text():
    text = b"some words of it " * 1_500_000
    tracemalloc.start()
    sh.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    found = sh.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(r.fingerprint, 16) == fingerprint(texts[r.doc_id]) for r in found)
    assert [r.component_id for r in found] == components([r.doc_id for r in found], [int(r.fingerprint, 16) for r in found])
    assert sorted(r.doc_id for r in sh.keep_one(docs).collect()) == sorted({r.component_id for r in found})
