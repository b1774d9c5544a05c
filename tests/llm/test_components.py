import random

from tally.llm.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, j) for j in range(501, 560)]
    edges += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)]
    rnd.shuffle(edges)
    rows = edges + edges[:5] + [(b, a) for a, b in edges[:9]] + [(7, 7), (None, 3), (3, None)]
    found = connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()
    want = brute([e for e in edges if e[0] != e[1]])
    assert len(found) == len(want)
    assert {r["node"]: r["component"] for r in found} == want


def test_components_of_strings_and_of_nothing(spark):
    found = connected_components(spark.createDataFrame([("b", "a"), ("b", "c")], "src string, dst string"))
    assert {r["node"]: r["component"] for r in found.collect()} == {"a": "a", "b": "a", "c": "a"}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
