import re

from claimweave.llm import decontamination as dc


def shingles(text):
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute(docs, items, threshold=0.8):
    best = {}
    for doc_id, text in docs:
        held = shingles(text)
        for item_id, item in items:
            own = shingles(item)
            if own and len(own & held) >= round(threshold * len(own), 6):
                key = (doc_id, item_id)
                found = (round(len(own & held) / len(own), 6), len(own), len(own & held))
                best[key] = max(best.get(key, found), found)
    return sorted(((*k, n, shared, share) for k, (share, n, shared) in best.items()), key=str)


def item(number, length):
    return " ".join(f"item{number}word{i}" for i in range(length))


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_items_that_share_an_id(spark, make_docs):
    """Two benchmarks joined: a document that holds one of two texts of an id whole is found."""
    items = [(1, item(1, 30)), (1, item(2, 60)), (1, item(2, 60)), (None, item(3, 30)), (None, item(4, 30)), (2, item(1, 30))]
    docs = [(n, f"before {item(k, 60)} after") for n, k in enumerate((1, 2, 3, 4, 9))] + [(10, item(1, 30) + " and " + item(2, 60))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = rows_of(dc.contained_items(make_docs(docs), frame))
    assert found == brute(docs, items) and {(r[0], r[1]) for r in found} == {(0, 1), (0, 2), (1, 1), (2, None), (3, None), (10, 1), (10, 2)}
    assert {r.doc_id for r in dc.decontaminate(make_docs(docs), frame).collect()} == {4}


def test_every_size_and_share(spark, make_docs):
    items = [(n, item(n, n)) for n in (1, 2, 4, 5, 6, 9, 12, 13, 20, 36, 37, 68, 69, 150)] + [(500, None), (501, ""), (None, item(7, 30))]
    docs = []
    for n, text in items:
        found = (text or "").split(" ")
        for k, lost in enumerate((0, 1, len(found) // 10, len(found) // 6, len(found) // 5, len(found) // 4, len(found) // 2)):
            docs.append((len(docs), "before that " * 40 + " ".join(found[: len(found) - lost]) + ", after " * (k + 3)))
            docs.append((len(docs), " ".join(found[lost:]).upper() + "!"))
    both = items[5][1] + ". " + items[8][1]
    docs += [(1000, both), (1000, items[5][1]), (None, both), (None, both), (1001, None), (1002, "")]
    expected = brute(docs, items)
    assert len({e[4] for e in expected}) > 3
    frame = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    assert rows_of(dc.contained_items(make_docs(docs), frame)) == expected
    left = dc.decontaminate(make_docs(docs), frame)
    hit = {(e[0], t) for e in expected for i, t in docs if i == e[0] and brute([(i, t)], items)}
    assert left.columns == make_docs([]).columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(str(d) for d in docs if d not in hit)


def test_joined_by_shuffling(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    items = [(n, item(n, n)) for n in (6, 20, 40)]
    docs = [(1, "x y " + item(20, 20)), (2, item(6, 6) + " z " + item(40, 38)), (3, "none of it")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(dc.contained_items(make_docs(docs), frame)) == brute(docs, items)


def test_whole_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf('sf0.01')}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert expected and rows_of(dc.contained_items(docs, items)) == expected
    assert dc.decontaminate(docs, items).count() == docs.count() - len({e[0] for e in expected})


def test_empty_tables_and_odd_rows(spark, make_docs, odd_rows):
    items = spark.createDataFrame([(1, "one text of some words, for a start."), (2, "a"), (3, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.contained_items(make_docs(odd_rows), items).collect()}
    assert found == {(1, 1), (2, 1), (6, 2)}
    assert dc.contained_items(make_docs([]), items).count() == 0
    assert dc.contained_items(make_docs(odd_rows), items.limit(0)).count() == 0
    assert dc.decontaminate(make_docs(odd_rows), items.limit(0)).count() == len(odd_rows)


def test_only_dataframe_functions(spark, make_docs, monkeypatch):
    plans = []
    stored = dc.materialize

    def recorded(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stored(rows, name)

    monkeypatch.setattr(dc, "materialize", recorded)
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plans.append(dc.contained_items(make_docs([(1, "a b c d e f g")]), items)._jdf.queryExecution().executedPlan().toString())
    assert not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
