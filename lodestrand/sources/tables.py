"""The input tables as the operators take them: one row a record, categories in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import slug
from lodestrand.session import table

LABELS = ("REQUIRED", "SUFFICIENT", "CONTEXT", "IRRELEVANT", "HARMFUL")
PATHS = ("P0", "P1", "P2", "P3", "P4", "P5")


def first_delivery(df: DataFrame, key: str, at: str = "ingested_at") -> DataFrame:
    """One row for each key, the one delivered first; found with map-side combining, so a hot key costs no more than others."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), at).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _wanted(raw: DataFrame, key: str, parts: dict[str, tuple[str, Column]], names: tuple[str, ...]) -> DataFrame:
    """The first delivery of each record, in the named columns (all, if none is named); only what they are made of is read and moved."""
    chosen = names or tuple(parts)
    sources = dict.fromkeys(parts[n][0] for n in chosen)
    once = first_delivery(raw.select(key, *sources, "ingested_at"), key)
    return once.select(key, *[parts[n][1].alias(n) for n in chosen])


def questions(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """question_id and the named ones (or all) of domain, category, language, query_text, source_group_id, authoring_source_ids."""
    parts = {
        "domain": ("domain", slug("domain")), "category": ("construction_category", slug("construction_category")), "language": ("language", F.lower(F.trim("language"))),
        **{c: (c, F.col(c)) for c in ("query_text", "source_group_id", "authoring_source_ids")},
    }
    return _wanted(table(spark, sf_dir, "queries"), "question_id", parts, names)


def sections(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """source_id and the named ones (or all) of domain, document_id, heading, content, source_type, runtime_locator, section_number (of the heading, or null)."""
    number = F.nullif(F.regexp_extract("heading", r"^\s*([0-9]+(?:\.[0-9]+)*)", 1), F.lit(""))
    parts = {
        "domain": ("domain", slug("domain")), **{c: (c, F.col(c)) for c in ("document_id", "heading", "content", "source_type", "runtime_locator")}, "section_number": ("heading", number),
    }
    return _wanted(table(spark, sf_dir, "source_sections"), "source_id", parts, names)


def finite(name: str) -> Column:
    """The value of a score, null unless it is finite."""
    value = F.col(name)
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, source_id, rank, score, reranker_score, candidate_id: the best occurrence of each source of a question."""
    raw = table(spark, sf_dir, "retrieval_candidates").where("question_id is not null and source_id is not null")
    place = F.struct(F.col("rank").isNull().alias("n"), F.col("rank").alias("r"), F.col("candidate_id").alias("c"))
    row = F.struct("rank", finite("score").alias("score"), finite("reranker_score").alias("reranker_score"), "candidate_id")
    best = raw.groupBy("question_id", "source_id").agg(F.min_by(row, place).alias("_r"))
    return best.select("question_id", "source_id", "_r.*")


def delivered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, question_id, source_id, rank, domain: every candidate as delivered, only redeliveries of a candidate_id removed."""
    raw = table(spark, sf_dir, "retrieval_candidates").where("question_id is not null")
    unnamed = raw.where("candidate_id is null").select(*raw.columns)
    once = first_delivery(raw, "candidate_id").unionByName(unnamed)
    return once.select("candidate_id", "question_id", "source_id", "rank", slug("domain").alias("domain"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid labels, one row a delivery: question_id, path_id, evidence_id, evidence_kind, label, role, annotator, reason, annotated_at."""
    once = first_delivery(table(spark, sf_dir, "evidence_annotations"), "annotation_id")
    label = F.upper(slug("label"))
    return once.select(
        "annotation_id", "question_id", "path_id", "evidence_id", "evidence_kind", label.alias("label"), slug("annotation_role").alias("role"),
        F.upper(slug("annotator_code")).alias("annotator"), "harmful_reason_code", "annotated_at", "annotated_at_offset", "ingested_at",
    ).where(label.isin(*LABELS))


def final_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label for each piece of evidence of a question and path: adjudicated before primary before duplicate, the latest of these."""
    order = F.when(F.col("role") == "adjudicated", 2).when(F.col("role") == "primary", 1).otherwise(0)
    latest = F.struct(order.alias("o"), F.col("annotated_at"), F.col("annotation_id"))
    keyed = annotations(spark, sf_dir).groupBy("question_id", "path_id", "evidence_id", "evidence_kind")
    return keyed.agg(F.max_by("label", latest).alias("label"), F.max_by("harmful_reason_code", latest).alias("harmful_reason_code"))
