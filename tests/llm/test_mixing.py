from pyspark.sql import functions as F

from lodestrand.llm.mixing import greatest_exact, mix, water_fill

TARGETS = "source string, target_share double, max_repeats int"


def test_water_filling():
    shares, sizes, caps = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100.0, "b": 1000.0}, {"a": 2.0, "b": 1.0, "c": 3.0}
    got = water_fill(shares, sizes, caps, 800.0)
    assert got == {"a": 200.0, "b": 600.0, "c": 0.0}
    assert water_fill(shares, sizes, caps, 5000.0) == {"a": 200.0, "b": 1000.0, "c": 0.0}
    total = greatest_exact(shares, sizes, caps)
    exact = water_fill(shares, sizes, caps, total)
    assert abs(exact["a"] / total - 0.5 / 0.8) < 1e-9 and exact["a"] <= 200.0 and greatest_exact({}, {}, {}) == 0.0


def test_mix_reaches_shares_and_caps(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(3000)] + [(5000 + i, "small", 11) for i in range(40)] + [(9000, "unnamed", 5), (9001, "small", 0), (0, "big", 10)]
    records = spark.createDataFrame(rows, "_d bigint, _s string, _n bigint")
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("Small ", 0.5, 3), ("absent", 0.2, 2), (None, 0.1, 1)], TARGETS)
    drawn, report = mix(records, targets, exact=True)
    by = {r["source"]: r for r in report.collect()}
    assert by["Small "]["tokens_in_mix"] == 40 * 11 * 3 and abs(by["BIG"]["share_reached"] - 0.5) < 0.01 and by["absent"]["tokens_in_mix"] == 0
    got = drawn.groupBy("source").agg(F.max("repeats").alias("m"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in got) and {r["source"]: r["m"] for r in got} == {"BIG": 1, "Small ": 3}
    # By default the mix is as large as the records of its sources, and the small source is clamped.
    clamped = {r["source"]: r for r in mix(records, targets)[1].collect()}
    assert clamped["Small "]["epochs"] == 3.0 and abs(sum(r["tokens_in_mix"] for r in clamped.values()) - clamped["BIG"]["tokens_available"] - 440) < 20
    full = {r["source"]: r for r in mix(records, targets, total=10_000.0)[1].collect()}
    assert full["Small "]["epochs"] == 3.0 and abs(full["BIG"]["tokens_in_mix"] - (10_000 - 1320)) < 20


def test_empty(spark):
    none = spark.createDataFrame([], "_d bigint, _s string, _n bigint")
    drawn, report = mix(none, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert drawn.count() == 0 and report.first()["share_reached"] == 0.0
    assert mix(none, spark.createDataFrame([], TARGETS))[1].count() == 0
