import datetime
import random

from lodestrand.llm.consensus import Voting, krippendorff, valid_votes

LABELS = ("REQUIRED", "SUFFICIENT", "CONTEXT")
SCHEMA = "q string, p string, annotator string, label string, role string, at timestamp, id string, why string, _x int"


def votes(spark, rows):
    return valid_votes(spark.createDataFrame(rows, SCHEMA), ("q", "p"), "annotator", "label", "role", "at", LABELS, "id", "why")


def at(k):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=k)


def test_latest_valid_label_stands_however_spelled(spark):
    rows = [
        ("q1", "P0", "ANN-A", " required ", "primary", at(1), "1", None, 0), ("q1", "P0", "ann a", "Context", "duplicate", at(2), "2", None, 0), ("q1", "P0", "ANN_A", "UNSURE", "primary", at(3), "3", None, 0),
        ("q1", "P0", "ANN-B", "CONTEXT", "duplicate", at(1), "4", None, 0), ("q2", "P0", "ANN-B", None, "duplicate", at(1), "5", None, 0), ("q2", None, "ANN-B", "CONTEXT", "duplicate", at(1), "6", None, 0),
        ("q3", "P0", "ANN-B", "CONTEXT", None, at(1), "7", None, 0), ("q3", "P0", None, "CONTEXT", "primary", at(1), "8", None, 0),
    ]
    got = votes(spark, rows).collect()
    assert sorted((r["_item"]["q"], r["_a"], r["_x"]) for r in got) == [("q1", "ANN_A", 2), ("q1", "ANN_B", 2)]


def test_reliable_minority_wins_and_swappers_are_used(spark):
    random.seed(2)
    rows, truth = [], {}
    for i in range(400):
        y = random.randrange(3)
        truth[f"q{i}"] = LABELS[y]
        said = {"good1": y if random.random() < 0.95 else random.randrange(3), "good2": y if random.random() < 0.95 else random.randrange(3), "good3": y if random.random() < 0.9 else random.randrange(3), "lazy1": 2, "lazy2": 2, "swap": {0: 1, 1: 0, 2: 2}[y]}
        for a in random.sample(list(said), 5):
            rows.append((f"q{i}", "P0", a, LABELS[said[a]], "duplicate", at(i), f"{i}{a}", None, 0))
    voting = Voting(votes(spark, rows), 3)
    got = {r["_item"]["q"]: LABELS[r["_y"]] for r in voting.consensus().collect()}
    assert sum(got[q] == y for q, y in truth.items()) > 385
    reliability = {name: (accuracy, bits) for name, _, accuracy, bits, *_ in voting.reliability()}
    assert voting.converged and all(r[4:] == (voting.iterations, True) for r in voting.reliability())
    assert not Voting(votes(spark, rows), 3, rounds=1).converged
    assert reliability["GOOD1"][0] > 0.85 and reliability["LAZY1"][1] < 0.05 < reliability["SWAP"][1] and reliability["SWAP"][0] < 0.6


def test_settled_items_and_single_votes(spark):
    rows = [("q1", "P0", "a", "CONTEXT", "primary", at(1), "1", None, 0), ("q1", "P0", "b", "CONTEXT", "duplicate", at(1), "2", None, 0), ("q1", "P0", "judge", "REQUIRED", "adjudicated", at(2), "3", None, 0), ("q2", "P0", "a", "CONTEXT", "primary", at(1), "4", None, 0)]
    got = [(r["_item"]["q"], r["_y"]) for r in Voting(votes(spark, rows), 3, anchored=True).consensus().collect()]
    assert got == [("q1", 0)]
    # Unanchored, the votes alone decide.
    got = [(r["_item"]["q"], r["_y"], [v["_a"] for v in r["_v"]]) for r in Voting(votes(spark, rows), 3).consensus().collect()]
    assert got == [("q1", 2, ["A", "B"])]


def test_alpha(spark):
    rows = [(f"q{i}", "P0", a, LABELS[x], "primary", at(1), f"{i}{a}", None, 0) for i, (x, y) in enumerate([(0, 0), (1, 1), (0, 1), (2, 2)]) for a, x in (("a", x), ("b", y))] + [("q9", "P0", "a", "CONTEXT", "primary", at(1), "z", None, 0)]
    got = krippendorff(votes(spark, rows), 3).first()
    # Eight ratings: 3, 3 and 2 of the labels; one of four pairs differs.
    expected = (64 - 9 - 9 - 4) / 56
    assert got["items"] == 4 and abs(got["alpha"] - (1 - 0.25 / expected)) < 1e-12


def test_no_votes(spark):
    none = votes(spark, [])
    assert Voting(none, 3).consensus().count() == 0 and krippendorff(none, 3).first()["alpha"] is None
