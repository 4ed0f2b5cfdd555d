import random

from claimweave.llm.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_same_as_union_find(spark):
    chance = random.Random(1)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(1000, 1040)]  # a chain
    edges += [(2000, i) for i in range(2001, 2060)] + [(5, 5), (7, 3), (3, 7)]  # a hub, a loop, both directions
    expected = union_find([e for e in edges if e[0] != e[1]])
    found = connected_components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r.node: r.component for r in found} == expected and len(found) == len(expected)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, None), (None, None), (4, 4)], "x long, y long")).count() == 0
