import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import quality_rules as qr

from .conftest import WORD, words


def brute(text):
    found = words(text)
    windows = Counter(zip(found, found[1:], found[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(found, found[1:], found[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return [len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(covered)]


def test_statistics_of_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (30, "a b c a b c\na b c\n\na b c\r\n x\x0by\x1cz | # <b>"), (31, "w " * 400), (32, "\n".join(["same line of text"] * 30))]
    found = qr.document_statistics(make_docs(rows)).collect()
    assert sorted(([getattr(r, b) for b in qr.BASE] for r in found)) == sorted(brute(r[1]) for r in rows)


def test_verdicts(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf('sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in qr.judge_rules(docs, labels).collect()}
    for i, r in found.items():
        assert [getattr(r, b) for b in qr.BASE] == brute(texts[i])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    passed = [(found[i].kept, q) for i, q in marked.items() if i in found and not found[i].base_failed]
    assert np.mean([k for k, q in passed if q == 1]) > 0.97 and np.mean([k for k, q in passed if q == 0]) < 0.15


def test_forest_isolates_outliers():
    random = np.random.default_rng(2)
    rows = random.normal(0, 1, (2000, 4))
    forest = qr.IsolationForest(rows, trees=100)
    assert forest.scores(np.full((1, 4), 6.0))[0] > np.quantile(forest.scores(rows), 0.99)
    alike = qr.IsolationForest(np.ones((10, 3)), trees=5)
    assert np.isfinite(alike.scores(np.ones((2, 3)))).all()


def test_threshold_is_of_least_cost():
    random = np.random.default_rng(3)
    rows = np.concatenate([random.normal(0, 1, (600, 3)), random.normal(7, 1, (60, 3))])
    good = np.arange(660) < 600
    order = random.permutation(660)
    judge = qr.fit_judge(rows[order], good[order])
    scores = judge.scores(rows)
    assert (scores[good] <= judge.threshold).mean() > 0.97 and (scores[~good] > judge.threshold).mean() > 0.9


def test_without_labels(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (99, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        found = qr.judge_rules(make_docs(odd_rows), labels).collect()
        assert len(found) == len(odd_rows) and all(r.kept == (not r.base_failed) for r in found)
        assert qr.judge_rules(make_docs([]), labels).collect() == []


def test_threshold_of_a_table_is_the_one_of_its_rows(spark):
    """Against the same rule in one array, with equal scores on both sides of a range."""
    random = np.random.default_rng(5)
    for good_share, steps in ((0.8, 40), (0.8, 4000), (0.02, 40), (0.0, 40), (1.0, 40)):
        good = random.random(1500) < good_share
        scores = np.round((random.random(1500) + 0.3 * ~good) / 1.3 * steps) / steps
        frame = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good, strict=True)], "score double, good boolean").repartition(5)
        assert qr.threshold_of(frame) == qr.least_cost(scores, good)
    assert qr.threshold_of(frame.limit(0)) is None


def test_every_labelled_row_counts(spark, monkeypatch):
    """Each of them is drawn from or scored for the threshold, however many there are: no bound on the labelled rows."""
    rows = [(i, " ".join(f"{'word' if i % 10 else 'W#RD'}{(i * 7 + k * k) % 97}" for k in range(60))) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    counted, plain = [], qr.threshold_of
    monkeypatch.setattr(qr, "threshold_of", lambda scored: (counted.append(scored.count()), plain(scored))[1])
    found = qr.judge_rules(docs, labels)
    assert 11_500 < counted[0] < 12_500
    assert found.where(F.col("kept") == (F.col("doc_id") % 10 != 0)).count() > 23_000
