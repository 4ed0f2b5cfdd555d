import math
import zlib
from collections import Counter

import numpy as np

from claimweave.llm import language_model as lm

from .conftest import lower, words


def brute(docs, folds=10):
    tokens = [[*words(lower(t)), ""] for _, t in docs]
    held = [i is None or zlib.crc32(str(i).encode()) % folds == 0 for i, _ in docs]
    counts = Counter(w for own, out in zip(tokens, held, strict=True) if not out for w in own)
    total, distinct = sum(counts.values()), len(counts)
    return [
        (str(i), out, len(own), sum(w in counts for w in own), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), 4))
        for (i, _), own, out in zip(docs, tokens, held, strict=True)
    ]


def rows_of(found):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found)


def test_counts_and_base_scores(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"The word{i} AND word{i % 7}\tÉ and") for i in range(60)]
    for frequent in (0, 3, 50, 10_000):
        found = lm.score_texts(make_docs(rows), frequent=frequent).collect()
        assert rows_of(found) == sorted(brute(rows)) and all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_better_than_counts_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    found = lm.score_texts(docs).collect()
    assert rows_of(found) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and np.mean([r.score > r.base_score for r in held]) > 0.9


def test_probabilities_sum_to_one():
    random = np.random.default_rng(1)
    names = ["", *(f"w{i}" for i in range(2499))]
    counts = sorted(random.integers(1, 1000, 2500).tolist(), reverse=True)
    vocabulary = lm.Vocabulary(names, counts, sum(counts) + 40, 2500 + 40)
    model = lm.Maxent(vocabulary.class_bias, vocabulary.slot_bias, random.normal(0, 0.5, lm.WEIGHTS).astype(np.float32))
    every = np.arange(lm.KNOWN + 1)
    for previous, skipped in ((lm.START, lm.START), (3, 90), (lm.OTHER, 1500)):
        log = model.log10(every, np.full(len(every), previous), np.full(len(every), skipped)).astype(np.float64)
        assert abs((10**log).sum() - 1) < 1e-3
    # Within the last class: the words beyond, forty that were seen once, and any other.
    beyond = np.array([*counts[lm.KNOWN :], *([1] * 40), 0]) + 0.1
    assert abs((beyond / 10**vocabulary.log_other).sum() - 1) < 1e-9


def test_gradient_lowers_the_loss():
    random = np.random.default_rng(2)
    counts = [100] * lm.KNOWN
    vocabulary = lm.Vocabulary([f"w{i}" for i in range(lm.KNOWN)], counts, sum(counts), len(counts))
    words_ = random.integers(0, 40, 4000)
    words_[1::2] = (words_[::2] * 7) % lm.KNOWN  # every second word follows from the one before
    part = lm._contexts([words_.astype("<u2")])
    zero = lambda: lm.Maxent(vocabulary.class_bias, vocabulary.slot_bias, np.zeros(lm.WEIGHTS, np.float32))
    model, squares = zero(), zero()
    before = model.log10(*part).mean()
    for _ in range(30):
        model.update(squares, *part)
    assert model.log10(*part).mean() > before + 0.3


def deep():
    """Words beyond the known ones, in a tree of one level, with the model's parts."""
    names = ["", *(f"w{i}" for i in range(2499))]
    counts = list(range(5000, 2500, -1))
    vocabulary = lm.Vocabulary(names, counts, sum(counts), 2500)
    hashes = np.array([zlib.crc32(w.encode()) for w in names]) & (vocabulary.cells - 1)
    cells = np.unique(hashes)
    own = np.array(counts, float)
    vocabulary.fill_cells(cells, np.array([own[hashes == c].sum() for c in cells]), np.array([(hashes == c).sum() for c in cells]))
    return vocabulary, own


def test_every_word_has_a_probability_of_its_own():
    vocabulary, counts = deep()
    assert vocabulary.depth == 1 and lm.Vocabulary([""], [1], 1, 300_000).depth == 3
    weights = np.random.default_rng(3).normal(0, 0.5, lm.WEIGHTS).astype(np.float32)
    model = lm.Maxent(vocabulary.class_bias, vocabulary.slot_bias, weights, vocabulary.branch_bias)
    ids = vocabulary.ids.astype(np.int64)
    for previous, skipped in ((lm.START, lm.START), (ids[2100], 90), (ids[2200], ids[2300])):
        log = model.log10(ids, np.full(len(ids), previous), np.full(len(ids), skipped)).astype(np.float64)
        other = ids >= lm.HASHED
        inside = 10 ** log[other] * (counts[other] + 0.1) / 10 ** vocabulary.log_cells[ids[other] & (vocabulary.cells - 1)]
        unseen = 0.1 / 10 ** vocabulary.log_cells  # in each cell, any word that was not counted
        cells = np.arange(vocabulary.cells) + lm.HASHED
        rest = 10 ** model.log10(cells, np.full(len(cells), previous), np.full(len(cells), skipped)).astype(np.float64) * unseen
        assert abs((10 ** log[~other]).sum() + inside.sum() + rest.sum() - 1) < 1e-3


def test_rare_words_follow_from_rare_words():
    """Pairs of words beyond the known ones are learnt: their second word becomes likelier after the first, not after others."""
    vocabulary, _ = deep()
    text = np.tile(vocabulary.ids[[2100, 2200, 2150, 2300]], 1000)
    model = lm.Maxent(vocabulary.class_bias, vocabulary.slot_bias, np.zeros(lm.WEIGHTS, np.float32), vocabulary.branch_bias)
    squares = lm.Maxent(vocabulary.class_bias, vocabulary.slot_bias, np.zeros(lm.WEIGHTS, np.float32))
    for _ in range(30):
        model.update(squares, *lm._contexts([text]))
    after = lambda w, v: float(model.log10(*(np.array([x]) for x in (vocabulary.ids[w].astype(np.int64), vocabulary.ids[v].astype(np.int64), lm.START)))[0])
    assert after(2200, 2100) > after(2200, 2150) + 0.2 and after(2300, 2150) > after(2300, 2100) + 0.2


def test_contexts_stay_within_texts():
    words_, previous, skipped = lm._contexts([np.array([5], "<u2"), np.array([6, 7, 8], "<u2")])
    assert words_.tolist() == [5, 6, 7, 8] and previous.tolist() == [lm.START, lm.START, 6, 7] and skipped.tolist() == [lm.START, lm.START, lm.START, 6]


def test_empty_and_untrained(make_docs):
    assert lm.score_texts(make_docs([])).collect() == []
    found = lm.score_texts(make_docs([(None, "only a held out text"), (None, None)])).collect()
    assert rows_of(found) == sorted(brute([(None, "only a held out text"), (None, None)]))
