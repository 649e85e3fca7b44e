import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm.sampling import controlled_rounding, controlled_sample, quotas, reachable

QUESTIONS = "question_id string, domain string, construction_category string, target_share double"
TARGETS = "domain string, construction_category string, target_share double, target_rows int, min_rows int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(0, 40), min_size=3, max_size=3), min_size=2, max_size=4))
def test_rounding_keeps_both_margins(rows):
    table = {(f"r{i}", f"c{j}"): x for i, r in enumerate(rows) for j, x in enumerate(r)}
    done = controlled_rounding(table)
    near = lambda got, want: abs(got - want) < 1 + 1e-6
    assert all(near(done[c], x) for c, x in table.items())
    for k in (0, 1):
        for name in {c[k] for c in table}:
            assert near(sum(x for c, x in done.items() if c[k] == name), sum(x for c, x in table.items() if c[k] == name))
    assert near(sum(done.values()), sum(table.values()))


def test_quotas_respect_floors_and_stock():
    shares = {("a", "x"): 0.5, ("a", "y"): 0.3, ("b", "x"): 0.19, ("b", "y"): 0.01}
    got = quotas(shares, {("a", "x"): 20, ("a", "y"): 500, ("b", "x"): 500, ("b", "y"): 500}, {c: 5 for c in shares}, 100)
    assert sum(got.values()) == 100 and got["a", "x"] == 20 and got["b", "y"] == 5


def test_margins_are_met_beyond_short_cells():
    shares = {("a", "x"): 0.3, ("a", "y"): 0.2, ("b", "x"): 0.3, ("b", "y"): 0.2}
    stock = {("a", "x"): 500, ("a", "y"): 500, ("b", "x"): 10, ("b", "y"): 500}
    got = quotas(shares, stock, dict.fromkeys(shares, 1), 100)
    # What (b, x) lacks comes from the rest of row b and of column x, so both margins are those of the shares.
    assert got == {("a", "x"): 50, ("a", "y"): 0 + 1, ("b", "x"): 10, ("b", "y"): 39} or (
        got["b", "x"] == 10 and sum(got.values()) == 100 and got["a", "x"] + got["a", "y"] == 50 and got["a", "x"] + got["b", "x"] in (59, 60)
    )
    # A row that can't give its margin is cut, the other takes the rest.
    got = quotas(shares, stock | {("b", "y"): 5}, dict.fromkeys(shares, 1), 100)
    assert got["b", "x"] == 10 and got["b", "y"] == 5 and sum(got.values()) == 100


def test_flow_reaches_what_there_is():
    assert reachable({("a", "x"): 5, ("b", "x"): 7, ("b", "y"): 0}, {("a", "x"): 9, ("b", "x"): 3}) == {("a", "x"): 5, ("b", "x"): 3, ("b", "y"): 0}
    assert reachable({}, {}) == {}


def test_sample_and_report(spark):
    random.seed(1)
    rows = [(f"q{i}", random.choice(["chemical", " Chemical", "CHEMICAL"]), random.choice(["direct_clause", "Direct Clause", "direct-clause"]), 0.1) for i in range(300)]
    rows += [(f"p{i}", "pharma", "table", 0.1) for i in range(7)] + [(f"n{i}", None, "table", 0.1) for i in range(9)] + [(None, "pharma", "table", 0.1), ("x", "other", "table", 0.1)] + rows[:40]
    targets = [("chemical", "direct_clause", 0.8, 80, 3), ("pharma", "table", 0.2, 20, 3)]
    sample, report = controlled_sample(spark.createDataFrame(rows, QUESTIONS), spark.createDataFrame(targets, TARGETS), "question_id", "domain", "construction_category")
    cells = {(r["domain"], r["construction_category"]): r for r in report.collect()}
    assert cells["chemical", "direct_clause"]["available"] == 300 and not cells["chemical", "direct_clause"]["short"]
    assert cells["pharma", "table"]["available"] == 7 and cells["pharma", "table"]["short"] and cells["pharma", "table"]["quota"] == 7
    got = sample.collect()
    assert len({r["question_id"] for r in got}) == len(got) == sum(c["quota"] for c in cells.values()) == 100
    again = controlled_sample(spark.createDataFrame(rows[::-1], QUESTIONS), spark.createDataFrame(targets, TARGETS), "question_id", "domain", "construction_category")[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_empty_tables(spark):
    none = spark.createDataFrame([], QUESTIONS)
    sample, report = controlled_sample(none, spark.createDataFrame([("a", "b", 1.0, 5, 1)], TARGETS), "question_id", "domain", "construction_category")
    assert sample.count() == 0 and report.first()["quota"] == 0 and report.first()["short"]
    sample, report = controlled_sample(none, spark.createDataFrame([], TARGETS), "question_id", "domain", "construction_category")
    assert sample.count() == report.count() == 0
