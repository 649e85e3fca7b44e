"""Contracts of the records around an evaluation: specifications, ranked units, sidecars, runs, authoring, manual searches, corpora.

Each gives the rules for quality.violations; a rule that gives null is broken, so rules say what null means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.quality import identifier, unique_items

# How a manual search may have been made, and what it concludes.
METHODS = ("identifier_lookup", "title_lookup", "full_text_search", "graph_relation_check", "manual_document_browse")
SUFFICIENT, INSUFFICIENT = "corpus_sufficient", "corpus_insufficient"


def specification_rules() -> dict[str, Column]:
    """required_source_ids, sufficient_source_ids, insufficiency_candidate: unique, apart from each other, some unless evidence is insufficient."""
    some = F.size("required_source_ids") + F.size("sufficient_source_ids") > 0
    return {
        "E_REQUIRED_IDS": unique_items("required_source_ids"), "E_SUFFICIENT_IDS": unique_items("sufficient_source_ids"),
        "E_ROLE_OVERLAP": ~F.arrays_overlap("required_source_ids", "sufficient_source_ids"), "E_EVIDENCE_MISSING": some | F.col("insufficiency_candidate"),
        "E_INSUFFICIENT_WITH_EVIDENCE": ~(some & F.col("insufficiency_candidate")),
    }


def unit_rules() -> dict[str, Column]:
    """Ranked units: ranks in their ranges, a reranker score in the unit interval if any, graph fields where and only where the graph gave the unit."""
    fields = ("graph_seed_source_id", "relation", "confidence")
    every, none = reduce(Column.__and__, [F.col(f).isNotNull() for f in fields]), reduce(Column.__and__, [F.col(f).isNull() for f in fields])
    return {
        "E_SOURCE_ID": identifier("source_id"), "E_RANK": F.col("rank").between(1, 10), "E_BM25_RANK": F.col("bm25_rank").between(1, 50),
        "E_RERANKER_SCORE": F.col("reranker_score").isNull() | (F.col("reranker_score").between(0, 1) & ~F.isnan("reranker_score")),
        "E_RELATION": F.col("relation").isNull() | F.col("relation").isin("CITES", "DEPENDS_ON"), "E_CONFIDENCE": F.col("confidence").isNull() | F.col("confidence").between(0, 1),
        "E_GRAPH_FIELDS": F.when(F.col("origin") == "graph", every).when(F.col("origin") == "direct", none),
    }


def sidecar_rules() -> dict[str, Column]:
    """Context sidecars: identified, of one of five seeds, at most the third of its seed, of a known type."""
    return {
        "E_SIDECAR_ID": identifier("sidecar_id"), "E_SEED_RANK": F.col("seed_rank").between(1, 5), "E_ORDER_WITHIN_SEED": F.col("order_within_seed").between(1, 3),
        "E_CONTEXT_TYPE": F.col("context_type").isin("heading_path", "immediate_parent", "table"),
    }


def run_rules() -> dict[str, Column]:
    """Runs (with ranked_source_ids and sidecar_ids): counts within bounds and true, an error code where and only where a run failed."""
    failed = F.col("status") == "execution_error"
    return {
        "E_STATUS": F.col("status").isin("complete", "execution_error"), "E_ERROR_CODE": failed == F.col("error_code").isNotNull(), "E_UNITS": F.size("ranked_source_ids") <= 10,
        "E_SIDECARS": (F.size("sidecar_ids") <= 15) & (F.size("sidecar_ids") == F.col("context_items_attached")), "E_GRAPH_TARGETS": F.col("graph_targets_inserted").between(0, 5),
        "E_FAILED_WITH_UNITS": ~(failed & (F.size("ranked_source_ids") > 0)),
    }


def authoring_rules() -> dict[str, Column]:
    """Authoring records: reviewer and time together, accepted ones checked, clear and (for insufficient evidence) with their manual search."""
    accepted, insufficient = F.col("review_decision") == "accept", F.col("construction_category") == "evidence_insufficient"
    return {
        "E_REVIEWER": F.col("reviewed_by").isNull() == F.col("reviewed_at").isNull(), "E_SOURCES_UNCHECKED": ~accepted | F.col("source_resolution_checked"),
        "E_PRIOR_CHECK": ~accepted | (F.col("prior_question_check") == "clear"), "E_ACCEPTED_UNREVIEWED": ~accepted | F.col("reviewed_by").isNotNull(),
        "E_SEARCH_MISSING": ~(accepted & insufficient) | F.col("manual_search_record_id").isNotNull(), "E_SEARCH_OUT_OF_PLACE": insufficient | F.col("manual_search_record_id").isNull(),
    }


def search_rules() -> dict[str, Column]:
    """Manual searches: known methods, each once; terms that differ once trimmed and lower-cased, none blank; a conclusion that fits what was found."""
    terms = F.transform("query_terms", lambda t: F.lower(F.trim(t)))
    return {
        "E_METHODS": unique_items("search_methods", 5) & (F.size("search_methods") > 0) & F.forall("search_methods", lambda m: m.isin(*METHODS)),
        "E_TERMS": F.forall(terms, lambda t: t != "") & (F.size(F.array_distinct(terms)) == F.size(terms)) & F.size(terms).between(1, 20),
        "E_SCOPE": F.length("search_scope").between(10, 1000), "E_RATIONALE": F.length("rationale").between(10, 1000),
        "E_CONCLUSION": F.col("conclusion") == F.when(F.col("evidence_found"), SUFFICIENT).otherwise(INSUFFICIENT),
    }


def corpus_mismatches(actual: DataFrame, expected: DataFrame, key: str = "domain", fields: tuple[str, ...] = ("corpus_hash", "record_count", "source_revision")) -> DataFrame:
    """(key, field): where the identity of a corpus isn't the expected one, nulls being equal; a corpus that one side lacks differs in its key."""
    there = lambda df, mark: df.select(key, *[F.col(f).alias(f"{mark}_{f}") for f in fields], F.lit(True).alias(mark))
    both = there(actual, "_a").join(there(expected, "_e"), key, "full")
    known = F.col("_a") & F.col("_e")
    wrong = F.array_compact(F.array(F.when(known.isNull(), F.lit(key)), *[F.when(known & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_e_{f}")), F.lit(f)) for f in fields]))
    return both.select(key, F.explode(wrong).alias("field"))
