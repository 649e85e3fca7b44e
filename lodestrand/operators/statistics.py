"""Scores of probabilities, agreement between annotators, and paired tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260723


def brier(p: str, y: str) -> Column:
    """The mean squared difference of a probability and an outcome."""
    return F.avg(F.pow(F.col(p) - F.col(y).cast("double"), F.lit(2.0)))


def calibration_bins(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of equal bins, the last one closed.

    Bins are found by comparison with the edges k/bins, not by multiplication, which would round some values up.
    """
    edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    number = F.size(F.filter(edges, lambda e: e <= F.col(p)))
    return rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def calibration_error(rows: DataFrame, p: str, y: str) -> DataFrame:
    """One row (brier, ece, rows)."""
    binned = calibration_bins(rows, p, y)  # at most ten rows
    ece = binned.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))
    return rows.agg(brier(p, y).alias("brier"), F.count(F.lit(1)).alias("rows")).crossJoin(ece)


def selective_metrics(rows: DataFrame, accepted: str, success: str) -> DataFrame:
    """One row: questions, accepted ones, coverage, abstention rate and the failure rate among the accepted (null if none)."""
    n, k = F.count(F.lit(1)), F.count_if(accepted)
    return rows.agg(
        n.alias("question_count"), k.alias("accepted_count"), F.round(F.try_divide(k, n), 9).alias("coverage"), F.round(1 - F.try_divide(k, n), 9).alias("abstention_rate"),
        F.round(1 - F.try_divide(F.count_if(F.col(accepted) & F.col(success)), k), 9).alias("accepted_failure_rate"),
    )


def paired_labels(annotations: DataFrame) -> DataFrame:
    """question_id, path_id, evidence_id, evidence_kind with the latest primary and duplicate label and reason, where both exist."""
    latest = F.struct("annotated_at", "annotation_id")
    both = annotations.where(F.col("role").isin("primary", "duplicate")).groupBy("question_id", "path_id", "evidence_id", "evidence_kind")
    of = lambda c, r: F.max_by(F.when(F.col("role") == r, F.col(c)), F.when(F.col("role") == r, latest))
    rows = both.agg(
        of("label", "primary").alias("primary_label"), of("label", "duplicate").alias("duplicate_label"), of("harmful_reason_code", "primary").alias("primary_reason"),
        of("harmful_reason_code", "duplicate").alias("duplicate_reason"), of("annotation_id", "primary").alias("primary_annotation_id"), of("annotation_id", "duplicate").alias("duplicate_annotation_id"),
    )
    return rows.where("primary_label is not null and duplicate_label is not null")


def confusion_matrix(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """primary_label with one count column a duplicate label."""
    return pairs.groupBy("primary_label").pivot("duplicate_label", list(labels)).count().fillna(0)


def agreement(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row: pairs, exact agreement and Cohen's kappa (null where fewer than two labels occur)."""
    counts = pairs.groupBy("primary_label", "duplicate_label").agg(F.count(F.lit(1)).alias("n"))  # at most one row a pair of labels
    side = lambda c, x: F.coalesce(F.sum(F.when(F.col(c) == x, F.col("n"))), F.lit(0)).cast("double")
    sums = counts.agg(
        F.sum("n").alias("pairs"), F.sum(F.when(F.col("primary_label") == F.col("duplicate_label"), F.col("n")).otherwise(0)).alias("same"),
        sum((side("primary_label", x) * side("duplicate_label", x) for x in labels), F.lit(0.0)).alias("chance"),
        sum((((side("primary_label", x) + side("duplicate_label", x)) > 0).cast("int") for x in labels), F.lit(0)).alias("used"),
    )
    po, pe = F.try_divide("same", "pairs"), F.try_divide("chance", F.col("pairs") * F.col("pairs"))
    return sums.select("pairs", F.round(po, 9).alias("exact_agreement"), F.round(F.when(F.col("used") > 1, F.try_divide(po - pe, 1 - pe)), 9).alias("kappa"))


def specific_agreement(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """label and 2 x both / (primary + duplicate), null for a label nobody gave."""
    sums = pairs.agg(*[x for k, name in enumerate(labels) for x in (
        F.count_if((F.col("primary_label") == name) & (F.col("duplicate_label") == name)).alias(f"b{k}"), (F.count_if(F.col("primary_label") == name) + F.count_if(F.col("duplicate_label") == name)).alias(f"s{k}"))])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.round(F.try_divide(2.0 * F.col(f"b{k}"), F.col(f"s{k}")), 9).alias("specific_agreement")) for k, name in enumerate(labels)])).alias("e")
    return sums.select(each).select("e.*")


def adjudication_queue(pairs: DataFrame, identify) -> DataFrame:
    """Pairs to be settled: labels differ, or both are HARMFUL for different reasons. identify makes the queue id."""
    label = F.col("primary_label") != F.col("duplicate_label")
    reason = (F.col("primary_label") == "HARMFUL") & (F.col("duplicate_label") == "HARMFUL") & ~F.col("primary_reason").eqNullSafe(F.col("duplicate_reason"))
    return pairs.where(label | reason).select(identify.alias("queue_id"), "*", F.when(label, "label_disagreement").otherwise("harmful_reason_disagreement").alias("queue_reason"))


def mcnemar(first_only: str, second_only: str) -> Column:
    """The exact two-sided p-value from the discordant counts.

    The tail of the binomial distribution is summed in logarithms, so that it holds for any number of pairs.
    """
    n, k = F.col(first_only) + F.col(second_only), F.least(F.col(first_only), F.col(second_only))
    start = F.struct((F.lit(0.0) - n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]
    return F.when((n == 0) | (k * 2 == n), 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(tests: DataFrame, p: str, *tie: str) -> DataFrame:
    """The tests with p_holm: step-down adjusted within this (small) family."""
    order = Window.partitionBy(F.lit(0)).orderBy(p, *tie)
    ranked = tests.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    stepped = F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), stepped)).drop("_r", "_m")


def paired_bootstrap(counts: DataFrame, keys: list[str], iterations: int = 10_000, seed: int = SEED) -> DataFrame:
    """keys with the mean paired difference and its 95 % bootstrap interval.

    counts: keys, difference (-1, 0 or 1), n: a question's difference is all that resampling questions needs, so each
    group is three rows however many questions there are, and a resample is one multinomial draw of the three counts.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", observed double, lower double, upper double, iterations int"

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("difference")
        n = int(pdf["n"].sum())
        draws = np.random.default_rng(seed).multinomial(n, pdf["n"] / n, size=iterations)
        means = draws @ pdf["difference"].to_numpy() / n
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([[*(pdf[k].iat[0] for k in keys), float((pdf["difference"] * pdf["n"]).sum() / n), float(low), float(high), iterations]], columns=[*keys, "observed", "lower", "upper", "iterations"])

    return counts.groupBy(*keys).applyInPandas(interval, schema)


def exact_bootstrap(pairs: DataFrame, keys: list[str], order: str, iterations: int = 10_000, seed: int = SEED) -> DataFrame:
    """As paired_bootstrap, by drawing questions with the PCG64 generator in the order of `order`; for families of frozen size.

    pairs: keys, order, difference. Reproduces intervals published for a hundred or so questions; one task holds a group.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", observed double, lower double, upper double, iterations int"

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(order)["difference"].to_numpy(dtype=float)
        rng = np.random.default_rng(seed)
        means = d[rng.integers(0, len(d), size=(iterations, len(d)))].mean(axis=1)
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([[*(pdf[k].iat[0] for k in keys), float(d.mean()), float(low), float(high), iterations]], columns=[*keys, "observed", "lower", "upper", "iterations"])

    return pairs.groupBy(*keys).applyInPandas(interval, schema)
