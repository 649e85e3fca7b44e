"""Evaluation queries (outcomes, policies, statistics, folds, signals) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.hashing import joined_hash
from lodestrand.operators import folds, outcomes, retrieval, routing, statistics, structure
from lodestrand.plans import evaluation_sql as sql
from lodestrand.session import table
from lodestrand.sources import tables

LABELS = tables.LABELS


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables.questions(spark, sf_dir, "domain", "category", "authoring_source_ids")
    return q.select("question_id", "domain", "category", F.array_distinct(F.coalesce("authoring_source_ids", F.array().cast("array<string>"))).alias("required"),
                    F.coalesce(F.col("category") == "evidence_insufficient", F.lit(False)).alias("insufficient"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.path_outcomes(tables.final_labels(spark, sf_dir), _specs(spark, sf_dir))


def _runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay from annotation to arrival stands in for a path's runtime."""
    delay = F.unix_timestamp("ingested_at") - F.unix_timestamp("annotated_at")
    return tables.annotations(spark, sf_dir).select("path_id", delay.alias("runtime_ms"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.path_costs(_runtimes(spark, sf_dir))


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed success rate of the stratum and path over questions of other folds."""
    keyed = _outcomes(spark, sf_dir).select("question_id", "path_id", "combined_path_success", F.coalesce("domain", F.lit("")).alias("d"), F.coalesce("category", F.lit("")).alias("c"))
    rows = keyed.join(folds.assign(tables.questions(spark, sf_dir, "source_group_id")).select("question_id", "fold"), "question_id")
    by_fold = rows.groupBy("d", "c", "path_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if("combined_path_success").alias("s"))
    stratum = Window.partitionBy("d", "c", "path_id")  # five rows each
    rest = lambda x: F.sum(x).over(stratum) - F.col(x)
    rate = by_fold.select("d", "c", "path_id", "fold", F.round((rest("s") + 1) / (rest("n") + 2), 9).alias("p"))
    return rows.join(rate, ["d", "c", "path_id", "fold"]).select("question_id", "path_id", "p", F.col("combined_path_success").alias("ok"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.top_scores(retrieval.first_stage(tables.candidates(spark, sf_dir)))


def path_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each labelled path of each question achieves."""
    return _outcomes(spark, sf_dir)


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by path, over all questions and by domain (null where a question has none)."""
    return outcomes.outcome_summary(_outcomes(spark, sf_dir))


def stratum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by domain, category and path."""
    return outcomes.stratum_summary(_outcomes(spark, sf_dir))


def stage_rescues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step rescues and loses, by stratum."""
    return outcomes.stage_rescues(_outcomes(spark, sf_dir))


def path_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each path."""
    return _costs(spark, sf_dir)


def oracle_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest successful path of each question."""
    return outcomes.oracle_policy(_outcomes(spark, sf_dir), _costs(spark, sf_dir))


def constant_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fixed policies."""
    return outcomes.constant_policies(tables.questions(spark, sf_dir, "domain"))


def heuristic_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that cue words and score gaps choose."""
    return outcomes.heuristic_policy(tables.questions(spark, sf_dir, "query_text"), _scores(spark, sf_dir))


def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each question and path before routing."""
    sections = tables.sections(spark, sf_dir, "document_id", "content", "section_number")
    stage = retrieval.first_stage(tables.candidates(spark, sf_dir), structure.SEEDS).select("question_id", "source_id")
    edges = structure.relation_edges(sections).where(F.col("confidence") >= structure.CONFIDENCE)
    meta = stage.join(edges, "source_id").groupBy("question_id").agg(F.count_distinct("source_id", "target_id").alias("eligible_outgoing_edge_count"), F.max("confidence").alias("max_edge_confidence"))
    questions = tables.questions(spark, sf_dir, "domain", "query_text")
    return outcomes.route_features(questions, _scores(spark, sf_dir), meta, _costs(spark, sf_dir))


def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted questions and failures at every threshold."""
    p = _probabilities(spark, sf_dir).select("question_id", "path_id", "p")
    return outcomes.threshold_table(p, _outcomes(spark, sf_dir), _costs(spark, sf_dir))


def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest threshold with a failure rate of at most 0.1 and of at most 0.6: forced abstention and a found one."""
    each = threshold_table(spark, sf_dir)
    strict = outcomes.select_threshold(each).withColumn("failure_bound", F.lit(0.10))
    return strict.unionByName(outcomes.select_threshold(each, most=0.60).withColumn("failure_bound", F.lit(0.60)))


def selective_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes at threshold 0.5, with and without abstention."""
    return outcomes.selective_routes(_probabilities(spark, sf_dir).select("question_id", "path_id", "p"), _costs(spark, sf_dir), 0.5)


def selective_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and risk of the routes at threshold 0.5."""
    routes = selective_route(spark, sf_dir)
    ok = _outcomes(spark, sf_dir).select("question_id", F.col("path_id").alias("selected_path_id"), "combined_path_success")
    joined = routes.join(ok, ["question_id", "selected_path_id"], "left").select((~F.col("abstained")).alias("kept"), F.coalesce("combined_path_success", F.lit(False)).alias("won"))
    return statistics.selective_metrics(joined, "kept", "won")


def brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and calibration error of the stratum rates."""
    found = statistics.calibration_error(_probabilities(spark, sf_dir), "p", "ok")
    return found.select(F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"), "rows")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.paired_labels(tables.annotations(spark, sf_dir))


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of primary and duplicate labels."""
    return statistics.agreement(_pairs(spark, sf_dir), LABELS)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary against duplicate labels."""
    return statistics.confusion_matrix(_pairs(spark, sf_dir), LABELS)


def specific_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement on each label."""
    return statistics.specific_agreement(_pairs(spark, sf_dir), LABELS)


def adjudication_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of labels that need settling."""
    identity = F.concat(F.lit("ADJQ-"), joined_hash("question_id", "evidence_kind", F.concat_ws("/", "path_id", "evidence_id"), length=16))
    return statistics.adjudication_queue(_pairs(spark, sf_dir), identity)


def mcnemar_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact test of each step, with Holm's adjustment over the family."""
    steps = outcomes.stage_rescues(_outcomes(spark, sf_dir)).groupBy("module", "before", "after").agg(F.sum("rescued").alias("rescued"), F.sum("lost").alias("lost"))
    tested = steps.withColumn("p_value", F.round(statistics.mcnemar("rescued", "lost"), 12))
    return statistics.holm(tested, "p_value", "module", "before").withColumn("p_holm", F.round("p_holm", 12))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of each step with its bootstrap interval."""
    steps = outcomes.stage_rescues(_outcomes(spark, sf_dir)).groupBy("module", "before", "after").agg(F.sum("questions").alias("q"), F.sum("rescued").alias("r"), F.sum("lost").alias("l"))
    each = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.col("r").alias("n")), F.struct(F.lit(-1).alias("d"), F.col("l").alias("n")), F.struct(F.lit(0).alias("d"), (F.col("q") - F.col("r") - F.col("l")).alias("n")))).alias("x")
    counts = steps.select("module", "before", "after", each).select("module", "before", "after", F.col("x.d").alias("difference"), F.col("x.n").alias("n"))
    return statistics.paired_bootstrap(counts, ["module", "before", "after"])


def signals_1_2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three signals."""
    return outcomes.signals(_outcomes(spark, sf_dir), _costs(spark, sf_dir))


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of each question by the hash of its source group."""
    return folds.assign(tables.questions(spark, sf_dir, "source_group_id"))


def fold_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and source groups of each part of each rotation."""
    assigned = folds.assign(tables.questions(spark, sf_dir, "source_group_id"))
    return folds.partition_summary(folds.rotations(assigned), assigned)


def partition_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken contracts of the frozen partitions."""
    return folds.partition_issues(table(spark, sf_dir, "fold_partitions"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions of each stratum for duplicate review."""
    return folds.stratified_sample(tables.questions(spark, sf_dir, "domain", "category"), 3)


def _oof(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = folds.assign(tables.questions(spark, sf_dir, "source_group_id"))
    return routing.pooled_oof(route_features(spark, sf_dir), _outcomes(spark, sf_dir), folds.rotations(assigned), _costs(spark, sf_dir), kind)


def router_oof_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold decisions of the logistic router."""
    return _oof("logistic", spark, sf_dir)


def router_oof_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold decisions of the boosted-tree router."""
    return _oof("boosted", spark, sf_dir)


def transfer_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on pharmaceutical questions by a logistic router fitted on chemical ones."""
    assigned = folds.assign(tables.questions(spark, sf_dir, "source_group_id"))
    return routing.transfer(route_features(spark, sf_dir), _outcomes(spark, sf_dir), assigned, _costs(spark, sf_dir), "chemical", "pharmaceutical", "logistic")


def signals_4_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two signals, for the logistic router."""
    return routing.late_signals(router_oof_lr(spark, sf_dir), heuristic_policy(spark, sf_dir), _outcomes(spark, sf_dir), _costs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        path_outcomes, outcome_summary, stratum_summary, stage_rescues, path_costs, oracle_policy, constant_policies, heuristic_policy, route_features, threshold_table, threshold_search,
        selective_route, selective_metrics, brier_ece, kappa, confusion_matrix, specific_agreement, adjudication_queue, mcnemar_stage, bootstrap_ci, signals_1_2_3, fold_assignment, fold_rotations,
        partition_issues, stratified_sample, router_oof_lr, router_oof_gbt, transfer_lr, signals_4_5,
    )
}
SQL = sql.SQL
