"""Queries over the operators of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import slug
from lodestrand.llm import components, consensus, lookalikes, mixing, oracle, overlap, sampling, tokens, topn, truncation
from lodestrand.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its plain form, with the kinds of other characters found in it."""
    of_queries = lookalikes.normalized(table(spark, sf_dir, "queries"), "question_id", ("query_text",), "queries")
    of_sections = lookalikes.normalized(table(spark, sf_dir, "source_sections"), "source_id", ("heading", "content"), "source_sections")
    return of_queries.unionByName(of_sections)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that hold characters other than the plain ones they look like."""
    return p1_normalized(spark, sf_dir).where(F.size("kinds") > 0).select("table_name", "record_id", "field_name").distinct()


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_overlaps(table(spark, sf_dir, "fold_partitions"), table(spark, sf_dir, "queries"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions that occur, exactly or nearly so, in the test and train lists of one row."""
    return _overlaps(spark, sf_dir).select(F.least("evaluated", "trained").alias("question_id_a"), F.greatest("evaluated", "trained").alias("question_id_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs and matched test questions for each outer_test_fold and domain of the test question."""
    pairs = _overlaps(spark, sf_dir).select("batch", "evaluated", "trained", "similarity", F.explode("folds").alias("f"))
    pairs = pairs.withColumn("outer_test_fold", F.col("f").try_cast("int")).drop("f")
    domains = table(spark, sf_dir, "queries").groupBy(F.col("question_id").alias("evaluated")).agg(F.min(slug("domain")).alias("domain"))
    return pairs.join(domains, "evaluated", "left").groupBy("outer_test_fold", "domain").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("batch", "evaluated").alias("test_questions"),
        F.count_if(F.col("similarity") == 1.0).alias("exact_pairs"),
    )


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.controlled_sample(
        table(spark, sf_dir, "queries"), table(spark, sf_dir, "sample_targets"), "question_id", "domain", "construction_category"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the targets for which there are too few questions."""
    return _sample(spark, sf_dir)[1].where("short").select("domain", "construction_category")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available, wanted and drawn questions of each target cell."""
    return _sample(spark, sf_dir)[1]


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of questions."""
    return _sample(spark, sf_dir)[0]


LABELS = ("REQUIRED", "SUFFICIENT", "CONTEXT", "IRRELEVANT", "HARMFUL")
ITEM = ("question_id", "path_id", "evidence_id")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.valid_votes(
        table(spark, sf_dir, "evidence_annotations"), ITEM, "annotator_code", "label", "annotation_role", "annotated_at", LABELS,
        "annotation_id", "harmful_reason_code",
    )


def _named(y: str) -> Column:
    return F.array(*map(F.lit, LABELS))[F.col(y)]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus label of each item with two annotators or more."""
    voting = consensus.Voting(_votes(spark, sf_dir), len(LABELS))
    return voting.consensus().select("_item.*", _named("_y").alias("consensus_label"))


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harmful_reason_code of each item whose consensus is HARMFUL: the one most given, then the first in order."""
    voting = consensus.Voting(_votes(spark, sf_dir), len(LABELS))
    harmful = voting.consensus().where(F.col("_y") == LABELS.index("HARMFUL"))
    given = F.transform(F.filter("_v", lambda v: v["_why"].isNotNull() & (v["_x"] == LABELS.index("HARMFUL"))), lambda v: v["_why"])
    best = F.array_max(F.transform(F.array_distinct("_w"), lambda w: F.struct(F.size(F.filter("_w", lambda o: o == w)).alias("n"), w.alias("w"))))
    return harmful.withColumn("_w", given).select("_item.*", best["w"].alias("harmful_reason_code"))


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha over the labels that stand."""
    return consensus.krippendorff(_votes(spark, sf_dir), len(LABELS)).select(
        "items", "ratings", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")]
    )


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, accuracy and informativeness of each annotator, each against the consensus of the others, and whether the rounds became stable."""
    voting = consensus.Voting(_votes(spark, sf_dir), len(LABELS))
    return spark.createDataFrame(voting.reliability(), "annotator_code string, votes bigint, accuracy double, bits double, rounds int, converged boolean")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(table(spark, sf_dir, "queries"), "question_id", {"source_group_id": components.letters_and_number})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test questions whose source group is, within the batch, in the test lists of more than one fold."""
    return components.straddling(
        table(spark, sf_dir, "fold_partitions"), _members(spark, sf_dir), "batch_id", "outer_test_fold", "test_question_ids", "question_id"
    )


def p5_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for each question that keeps each source group whole."""
    assigned, _ = components.assign_splits(_members(spark, sf_dir), table(spark, sf_dir, "split_targets"))
    return assigned.select("question_id", "component", "split_name")


def p5_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each question where authoring sources link questions as source groups do, so that links reach over many questions."""
    entities = {"source_group_id": components.letters_and_number, "authoring_source_ids": lambda c: F.transform(c, lambda s: F.nullif(F.trim(s), F.lit("")))}
    return components.components(table(spark, sf_dir, "queries"), "question_id", entities)


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the new splits reach."""
    return components.assign_splits(_members(spark, sf_dir), table(spark, sf_dir, "split_targets"))[1]


def _top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(
        table(spark, sf_dir, "retrieval_candidates"), "question_id", "candidate_id", ("reranker_score", "score"), ("rank", "source_id"), n=10
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first candidates of each question."""
    return _top_ten(spark, sf_dir).select("question_id", "candidate_id")


def p6_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first candidates of each question with their positions."""
    return _top_ten(spark, sf_dir)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(mixing.sized(table(spark, sf_dir, "documents"), "doc_id", "source", "text"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mix as large as the corpus and how often each appears; small sources are clamped at max_repeats."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that this mix reaches."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p8_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest mix in which every source that has records reaches its share, so that none is clamped."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), exact=True)[0]


def p8_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the greatest exact mix reaches."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), exact=True)[1]


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text was cut."""
    return _truncated(spark, sf_dir).where("cut").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text, cut ones, what showed the cut, and the rate of cutting of each source."""
    sources = table(spark, sf_dir, "documents").select("doc_id", slug("source").alias("source"))
    judged = sources.join(_truncated(spark, sf_dir), "doc_id")
    counts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut_documents"), *[
        F.count_if(F.col("cut") & (F.col("route") == r)).alias("by_" + r.replace(" ", "_")) for r in ("copy", "format", "line kind", "opening", "closing words")
    ])
    return counts.withColumn("cut_rate", F.col("cut_documents") / F.col("documents"))


QUERIES = (
    p1_found, p1_normalized, p2_found, p2_report,
    p3_found, p3_report, p3_sample, p4_found, p4_reasons, p4_agreement, p4_reliability, p5_found, p5_assignment, p5_shares, p5_linked,
    p6_found, p6_positions, p7_ids, p8_mix, p8_shares, p8_mix_exact, p8_shares_exact,
    p9_found, p9_rates,
)


def queries() -> dict[str, Query]:
    """Every query of this subpackage by name."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL by query name, where SQL can express the query on whole tables."""
    return {k: v for k, v in oracle.SQL.items() if k in queries()}
