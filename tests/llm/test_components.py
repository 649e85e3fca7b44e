import random

import pytest
from pyspark.sql import functions as F

from lodestrand.llm.components import assign_splits, components, contract, letters_and_number, straddling


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_contraction_finds_components(spark, kind):
    random.seed(4)
    edges = {
        "random": [(f"v{random.randrange(60)}", f"v{random.randrange(60)}") for _ in range(45)] + [("v1", "v1"), (None, "v2"), ("v1", "v2"), ("v1", "v2")],
        "path": [(f"v{i}", f"v{i + 1}") for i in range(25)],
        "star": [("hub", f"v{i}") for i in range(60)],
    }[kind]
    labels = {r["vertex"]: r["component"] for r in contract(spark.createDataFrame(edges, "u string, v string")).collect()}
    groups = {}
    for v in {x for e in edges for x in e if x is not None}:
        groups.setdefault(labels.get(v, v), set()).add(v)
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == brute(edges)


def test_spellings(spark):
    rows = [("CHEM-STANDARD-00000012",), ("chem standard 12",), ("Chem_Standard_012 ",), ("CHEM-STANDARD-13",), ("--",), (None,), ("x-0",), ("x-000",)]
    got = [r[0] for r in spark.createDataFrame(rows, "g string").select(letters_and_number("g")).collect()]
    assert got[0] == got[1] == got[2] != got[3] and got[4] is None and got[5] is None and got[6] == got[7] == "x#0"


def test_records_sharing_entities_and_splits(spark):
    rows = [(f"q{i}", f"G-{i // 3}", f"author {i % 50}" if i < 6 else None, "c") for i in range(90)] + [(f"hot{i}", "G-999", None, "c") for i in range(45)] + [(f"n{i}", None, None, "c") for i in range(10)]
    rows += rows[:5] + [(None, "G-1", None, "c")]
    df = spark.createDataFrame(rows, "id string, source string, author string, component string")
    members = components(df, "id", {"source": letters_and_number, "author": lambda c: F.lower(c)})
    got = {r["id"]: r for r in members.collect()}
    assert len(got) == 145 and len({got[f"hot{i}"]["component"] for i in range(45)}) == 1
    assert len({got[f"n{i}"]["component"] for i in range(10)}) == 10 and not got["n0"]["linked"]
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.2), ("validation", 0.2)], "split_name string, target_share double")
    assigned, report = assign_splits(members, targets)
    pairs = {(r["component"], r["split_name"]) for r in assigned.collect()}
    assert len(pairs) == len({c for c, _ in pairs}) and assigned.count() == 145
    assert all(abs(r["share"] - r["target_share"]) < 0.06 for r in report.collect())


def test_elements_of_arrays_are_entities(spark):
    rows = [("a", "G1", ["x", None, "y"]), ("b", "G2", ["y"]), ("c", "G3", []), ("d", "G2", None), ("e", None, ["z"]), ("f", "G3", ["w"])]
    df = spark.createDataFrame(rows, "id string, source string, authors array<string>")
    got = {r["id"]: r["component"] for r in components(df, "id", {"source": letters_and_number, "authors": F.col}).collect()}
    assert got["a"] == got["b"] == got["d"] and got["c"] == got["f"] and len(set(got.values())) == 3


def test_empty_records(spark):
    none = spark.createDataFrame([], "id string, source string")
    members = components(none, "id", {"source": letters_and_number})
    targets = spark.createDataFrame([("train", 1.0), ("test", None)], "split_name string, target_share double")
    assigned, report = assign_splits(members, targets)
    assert members.count() == assigned.count() == 0 and [r["records"] for r in report.collect()] == [0, 0]
    with pytest.raises(ValueError):
        assign_splits(members, targets.where("false"))


def test_straddling(spark):
    questions = spark.createDataFrame([("a", "G-1"), ("b", "g 01"), ("c", "G-2"), ("d", None), ("e", None), ("f", "G-2")], "id string, source string")
    folds = spark.createDataFrame([("B1", 0, ["a", "c", "d", "zz", "a", None]), ("B1", 1, ["b", "e"]), ("B2", 1, ["f"]), ("B1", 0, ["a", "c", "d", "zz", "a", None])], "batch string, fold int, ids array<string>")
    members = components(questions, "id", {"source": letters_and_number})
    assert sorted(r[0] for r in straddling(folds, members, "batch", "fold", "ids", "id").collect()) == ["a", "b"]
