import random

import pytest

from lodestrand.operators import folds, outcomes, statistics

OUT = "question_id string, path_id string, domain string, category string, evidence_complete boolean, harmful_expansion boolean, combined_path_success boolean, context_items_attached bigint"


def costs(spark, runtime=5):
    return outcomes.path_costs(spark.createDataFrame([(p, float(runtime + k)) for k, p in enumerate(outcomes.BUDGETS)], "path_id string, runtime_ms double"))


def grid(spark, success):
    return spark.createDataFrame([(q, p, "d", "c", ok, False, ok, 0) for q, paths in success.items() for p, ok in paths.items()], OUT)


def test_path_outcomes(spark):
    labels = spark.createDataFrame([
        ("q1", "P0", "A", "ranked", "REQUIRED"), ("q1", "P1", "A", "ranked", "REQUIRED"), ("q1", "P1", "B", "sidecar", "HARMFUL"), ("q1", "P2", "B", "ranked", "CONTEXT"),
        ("q2", "P0", "C", "ranked", "SUFFICIENT"), ("q3", "P0", "C", "ranked", "SUFFICIENT"), ("zz", "P0", "C", "ranked", "REQUIRED"),
    ], "question_id string, path_id string, evidence_id string, evidence_kind string, label string")
    specs = spark.createDataFrame([("q1", "d", "c", ["A"], False), ("q2", "d", "c", [], False), ("q3", "d", "c", [], True)], "question_id string, domain string, category string, required array<string>, insufficient boolean")
    got = {(r["question_id"], r["path_id"]): (r["evidence_complete"], r["harmful_expansion"], r["combined_path_success"]) for r in outcomes.path_outcomes(labels, specs).collect()}
    assert got == {("q1", "P0"): (True, False, True), ("q1", "P1"): (True, True, False), ("q1", "P2"): (False, False, False), ("q2", "P0"): (True, False, True), ("q3", "P0"): (False, False, False)}


def test_oracle_takes_the_cheapest_success(spark):
    rows = grid(spark, {"Q1": {"P0": False, "P2": True, "P4": True}, "Q2": {"P0": False, "P5": False}})
    got = {r["question_id"]: (r["selected_path_id"], r["abstained"], r["routable"]) for r in outcomes.oracle_policy(rows, costs(spark)).collect()}
    assert got == {"Q1": ("P2", False, True), "Q2": (None, True, False)}


def test_heuristic_precedence_and_boundary(spark):
    texts = [("a", "see the table cited here", [10.0, 1.0]), ("b", "as defined in part two", [10.0, 1.0]), ("c", "见附表和引用", [9.0, 1.0]), ("d", "APPENDIX only", [9.0, 1.0]), ("e", "plain words", [10.0, 8.5]), ("f", "plain words", [10.0, 8.6]), ("g", None, [10.0, 1.0]), ("h", "one score", [1.0])]
    df = spark.createDataFrame(texts, "question_id string, query_text string, scores array<double>")
    got = {r["question_id"]: r["selected_path_id"] for r in outcomes.heuristic_policy(df.drop("scores"), df.drop("query_text")).collect()}
    assert got == {"a": "P5", "b": "P3", "c": "P5", "d": "P2", "e": "P0", "f": "P1", "g": "P0"}


def test_features_refuse_later_information(spark):
    late = spark.createDataFrame([("q", "d", "t", 0.5)], "question_id string, domain string, query_text string, reranker_score double")
    with pytest.raises(ValueError):
        outcomes.route_features(late, late, late, costs(spark))


@pytest.mark.parametrize("most", [0.1, 0.5])
def test_thresholds_against_brute_force(spark, most):
    random.seed(3)
    paths = list(outcomes.BUDGETS)
    p = {(f"q{i}", x): random.choice([0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) for i in range(40) for x in paths}
    ok = {k: random.random() < v for k, v in p.items()}
    price = {x: k for k, x in enumerate(["P0", "P2", "P3", "P1", "P4", "P5"])}
    table = {}
    for t in sorted(set(p.values())):
        routes = [min((x for x in paths if p[q, x] >= t), key=price.get, default=None) for q in {q for q, _ in p}]
        chosen = [(q, x) for q, x in zip({q for q, _ in p}, routes, strict=True) if x]
        table[t] = (len(chosen), sum(not ok[c] for c in chosen))
    probabilities = spark.createDataFrame([(q, x, v) for (q, x), v in p.items()], "question_id string, path_id string, p double")
    results = spark.createDataFrame([(q, x, v) for (q, x), v in ok.items()], "question_id string, path_id string, combined_path_success boolean")
    got = outcomes.threshold_table(probabilities, results, costs(spark, 1))
    assert {r["threshold"]: (r["accepted"], r["failures"]) for r in got.collect()} == table
    best = outcomes.select_threshold(got, most=most).first()
    valid = [t for t, (n, bad) in table.items() if n >= 10 and bad / n <= most]
    assert best["threshold"] == (min(valid) if valid else None) and best["force_abstain"] == (not valid)


def test_signals(spark):
    rows = {f"q{i}": {p: (p == "P1" if i < 2 else False) for p in outcomes.BUDGETS} for i in range(10)}
    got = outcomes.signals(grid(spark, rows), costs(spark)).first()
    assert got["signal_1"] and not got["signal_2"] and got["rescued"] == 2 and got["rescued_by_reranking"] == 2
    assert outcomes.signals(grid(spark, {k: v for k, v in rows.items() if k != "q0"}), costs(spark)).first()["signal_1"] is False


def test_calibration_bins_and_brier(spark):
    rows = spark.createDataFrame([(0.8999999999999999, True), (0.9, False), (1.0, True), (0.0, False)], "p double, y boolean")
    bins = {r["bin"]: r["n"] for r in statistics.calibration_bins(rows, "p", "y").collect()}
    assert bins == {8: 1, 9: 2, 0: 1}
    got = statistics.calibration_error(rows, "p", "y").first()
    assert abs(got["brier"] - (0.01 + 0.81) / 4) < 1e-9 and abs(got["ece"] - (0.1 / 4 + abs(0.5 - 0.95) * 0.5)) < 1e-9


@pytest.mark.parametrize(("a", "b", "p"), [(2, 0, 0.5), (3, 1, 0.625), (9, 0, 0.00390625), (19, 0, 3.814697265625e-06), (0, 0, 1.0), (5, 5, 1.0), (16, 4, 0.01181793212890625)])
def test_mcnemar(spark, a, b, p):
    assert abs(spark.createDataFrame([(a, b)], "x bigint, y bigint").select(statistics.mcnemar("x", "y")).first()[0] - p) < 1e-12


def test_mcnemar_of_many_pairs(spark):
    assert 0 < spark.createDataFrame([(40_000, 39_000)], "x bigint, y bigint").select(statistics.mcnemar("x", "y")).first()[0] < 0.001


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double")
    assert {r["t"]: round(r["p_holm"], 6) for r in statistics.holm(rows, "p", "t").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_bootstraps_agree(spark):
    random.seed(1)
    d = [random.choice([-1, 0, 0, 1, 1]) for _ in range(120)]
    exact = statistics.exact_bootstrap(spark.createDataFrame([("k", f"q{i:03d}", x) for i, x in enumerate(d)], "k string, question_id string, difference int"), ["k"], "question_id").first()
    fast = statistics.paired_bootstrap(spark.createDataFrame([("k", x, d.count(x)) for x in (-1, 0, 1)], "k string, difference int, n bigint"), ["k"]).first()
    assert exact["observed"] == fast["observed"] and abs(exact["lower"] - fast["lower"]) < 0.02 and abs(exact["upper"] - fast["upper"]) < 0.02


def test_kappa(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "B")], "primary_label string, duplicate_label string")
    got = statistics.agreement(rows, ("A", "B")).first()
    assert got["exact_agreement"] == 0.75 and abs(got["kappa"] - 0.5) < 1e-9
    assert statistics.agreement(rows.where("primary_label = 'A' and duplicate_label = 'A'"), ("A", "B")).first()["kappa"] is None


def test_folds(spark):
    questions = spark.createDataFrame([(f"q{i}", f"g{i // 3}") for i in range(60)], "question_id string, source_group_id string")
    assigned = folds.assign(questions)
    rows = assigned.collect()
    assert all(len({r["fold"] for r in rows if r["source_group_id"] == g}) == 1 for g in {r["source_group_id"] for r in rows})
    rotated = folds.rotations(assigned).collect()
    assert len(rotated) == 300 and all(sum(r["question_id"] == f"q{i}" and r["part"] == "test" for r in rotated) == 1 for i in range(60))
