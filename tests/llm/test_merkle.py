import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from claimweave.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(leaves, fanout):
    """The root of a list of leaves, and for each of them what stands left and right of its ancestors."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, path in enumerate(paths):
            first = at[i] - at[i] % fanout
            path.append(("".join(level[first : at[i]]), "".join(level[at[i] + 1 : first + fanout])))
            at[i] //= fanout
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout=2):
    """Rows (doc_id, leaf, subroot, root, path) from (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: climb([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, above = climb([below[g][0] for g in order], fanout)
    found = []
    for g, further in zip(order, above, strict=True):
        for (has, doc_id, own), path in zip(sorted(groups[g]), below[g][1], strict=True):
            found.append((doc_id if has else None, own, below[g][0], root, path + further))
    return found


def report(rows):
    own = {leaf(*r): r for r in rows}
    found = []
    for doc_id, node, subroot, root, path in brute(rows):
        _, source, lang, n_chars, text = own[node]
        now = node
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            now = leaf(doc_id, source, lang, None if n_chars is None else n_chars + 1, text)
        for left, right in path:
            now = sha(left, now, right)
        found.append((doc_id, node, subroot, root, sha(*(left + right for left, right in path)), now, now == root))
    return found


NAMES = "doc_id long, source string, lang string, n_chars long, text string, leaf string, position int, block string, node0 double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1, "b", 0.5) for r in rows], NAMES)


def by_text(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def some_rows(count, seed):
    chance = random.Random(seed)
    langs = ["en"] * 5 + ["de", "", "é", "Z", None, *(f"l{i}" for i in range(9))]
    return [(i, f"s{i % 3}", chance.choice(langs), chance.choice([None, i, 2**63 - 1 if i % 5 == 0 else 7]), f"text {i} é" * (i % 4) or None) for i in range(count)]


@pytest.mark.parametrize("block", [2, 8, 1024])
def test_report_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = some_rows(333, 4)
    assert by_text(merkle.tamper_report(frame(spark, rows)).collect()) == by_text(report(rows))


@pytest.mark.parametrize("fanout", [3, 5])
def test_other_fanouts(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "BLOCK", 30)
    rows = some_rows(200, 5)
    found = merkle.merkle_manifest(frame(spark, rows), merkle.VALUES, fanout=fanout).collect()
    shown = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in found]
    assert by_text(shown) == by_text(brute(rows, fanout))
    assert sorted(r.position for r in found if r.lang == "en") == list(range(sum(r[2] == "en" for r in rows)))


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 9])
def test_small_trees(spark, count):
    rows = [(i, None, "x", 1, "t") for i in range(count)]
    assert by_text(merkle.tamper_report(frame(spark, rows)).collect()) == by_text(report(rows))


def test_odd_rows(spark, odd_rows):
    """Null and repeated ids, repeated rows, null, empty and long texts, ids as large as can be."""
    rows = [(i, "s", "x" if n % 3 else None, None, t) for n, (i, t) in enumerate(odd_rows)] + [(2**62, None, "x", None, "a" * 3_000_000), (-5, "s", "x", 2, "t")]
    found = merkle.tamper_report(frame(spark, rows)).collect()
    assert by_text(found) == by_text(report(rows))
    assert merkle.tamper_report(frame(spark, [])).collect() == []


def test_tampering_shows(spark, sf):
    docs = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    found = merkle.tamper_report(docs).collect()
    assert by_text(found) == by_text(report(rows))
    assert {r.verified for r in found} == {True, False}
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in found)


def test_one_shuffle_for_all_levels_of_a_tier(spark):
    nodes = spark.range(5000).selectExpr("'' AS group_key", "id AS position", "5000L AS n", "sha2(CAST(id AS STRING), 256) AS node")
    plan = merkle._tier(nodes, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Python" not in plan


def test_fold_and_proof_of_a_lone_leaf(spark):
    row = merkle.merkle_manifest(frame(spark, [(1, "s", "x", 1, "t")]), merkle.VALUES).select("leaf", "root", "path", merkle.proof_digest(F.col("path")).alias("proof")).first()
    assert row.leaf == row.root and row.path == [] and row.proof == sha()
