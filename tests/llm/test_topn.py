import random

import pytest

from lodestrand.llm.topn import top_n

SCHEMA = "g string, i bigint, a double, b double, r int, s string, rank int, position string"


def run(spark, rows, n=3, bins=8):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(x["g"], x["position"]): x["i"] for x in top_n(df, "g", "i", ("a", "b"), ("r", "s"), n=n, bins=bins).collect()}


def brute(rows, n):
    finite = lambda v: v if v is not None and v == v and abs(v) != float("inf") else None
    groups = {}
    for g, i, a, b, r, s, *_ in rows:
        if g is not None and i is not None:
            a, b = finite(a), finite(b)
            key = (a is None, -(a or 0), b is None, -(b or 0), r is None, r or 0, s is None, s or "")
            groups.setdefault(g, {})[i] = min(key, groups.get(g, {}).get(i, key))
    return {(g, p + 1): i for g, items in groups.items() for p, (i, _) in enumerate(sorted(items.items(), key=lambda x: (x[1], x[0]))[:n])}


def test_order_ties_nulls_and_redelivery(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("g", 1, 0.5, 1.0, 1, "x", 9, ""), ("g", 1, 0.5, 1.0, 1, "x", 9, ""), ("g", 2, 0.5, 1.0, 1, "w", 9, ""), ("g", 3, inf, 5.0, 1, "x", 9, ""), ("g", 4, nan, 6.0, None, "x", 9, ""),
        ("h", 5, None, None, None, None, 9, ""), ("h", 6, None, nan, 1, None, 9, ""), (None, 7, 1.0, 1.0, 1, "x", 9, ""), ("h", None, 1.0, 1.0, 1, "x", 9, ""),
    ]
    assert run(spark, rows) == brute(rows, 3) == {("g", 1): 2, ("g", 2): 1, ("g", 3): 4, ("h", 1): 6, ("h", 2): 5}


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_item_with_different_values_counts_once(spark):
    rows = [("g", 1, 0.1, 1.0, 1, "x", 0, ""), ("g", 1, 0.9, 1.0, 1, "x", 0, ""), ("g", 2, 0.5, 1.0, 1, "x", 0, ""), ("g", 3, 0.4, 1.0, 1, "x", 0, "")]
    assert run(spark, rows, n=3) == {("g", 1): 1, ("g", 2): 2, ("g", 3): 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_group_against_brute_force(spark, seed):
    random.seed(seed)
    rows = []
    for i in range(3000):
        g = "hot" if random.random() < 0.4 else f"g{random.randrange(40)}"
        a = random.choice([None, float("nan"), round(random.random(), 2), 0.5, -3.0, 1e30])
        rows.append((g, i % 2500, a, random.choice([None, round(random.random(), 1)]), random.choice([None, 1, 2]), random.choice("ab"), 0, ""))
    assert run(spark, rows, n=10) == brute(rows, 10)


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        run(spark, [], n=0)
