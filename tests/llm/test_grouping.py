"""Components and the deal against brute force."""

import random

from conftest import duck, rows

from siltworks.llm import catalogue, grouping


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {x: find(x) for x in up}


def check(spark, edges):
    labels, tree = grouping.forest(spark.createDataFrame(edges, "u string, v string"))
    got = {r["node"]: r["root"] for r in labels.collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    pair = {}
    for x in got:
        assert pair.setdefault(got[x], want[x]) == want[x]
    assert len(set(got.values())) == len(set(want.values()))
    t = [(r["u"], r["v"]) for r in tree.collect()]
    assert len(t) == len(got) - len(set(got.values()))  # a forest
    assert set(t) <= {tuple(sorted(e)) for e in edges}
    return max([r["round"] for r in tree.collect()] or [0])


def test_random_graph(spark):
    rnd = random.Random(3)
    check(spark, [(f"n{rnd.randrange(120):03d}", f"n{rnd.randrange(120):03d}") for _ in range(90)])


def test_chain_and_star_take_few_rounds(spark):
    assert check(spark, [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]) <= 8
    assert check(spark, [("hub", f"x{i}") for i in range(200)]) <= 3


def test_deal_meets_targets(spark):
    rnd = random.Random(5)
    roots = [(f"r{i}", rnd.choice([1, 1, 2, 3, 7, 20])) for i in range(3000)] + [("giant", 5000)]
    t = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
    got = grouping.deal(spark.createDataFrame(roots, "root string, n long"), t).collect()
    assert len(got) == len(roots) == len({r["root"] for r in got})
    total = sum(n for _, n in roots)
    for name, share in t:
        assert abs(sum(r["n"] for r in got if r["split"] == name) / total - share) < 0.01
    assert next(r["split"] for r in got if r["root"] == "giant") == "train"


def test_found_against_sql(spark, small):
    got = catalogue.queries()["p3_found"](spark, small).toPandas()
    assert rows(got) == duck(small, catalogue.oracle_sql()["p3_found"])
