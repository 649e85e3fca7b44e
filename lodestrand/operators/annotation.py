"""Blinded export, candidate structures, scope screening, prior questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.hashing import joined_hash
from lodestrand.functions.numbering import number_rows
from lodestrand.functions.text import block_similarity, normalized

SEED = 20260723


def question_codes(questions: DataFrame, seed: int = SEED) -> DataFrame:
    """question_id and a blinded code Q-0000001, numbered in order of a seeded hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), "question_id"), 256)
    return number_rows(questions.select("question_id").distinct(), digest, "question_id").select("question_id", F.format_string("Q-%07d", "number").alias("question_code"))


def blinded_rows(evidence: DataFrame, questions: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each piece of evidence of a question over all its packages, without path ids.

    evidence: question_id, path_id, evidence_kind, evidence_id. Rows have a code in seeded order, the question's code, the
    number of packages, and an identity hash over what the annotator sees; occurrences (the key to the paths) come last and are for
    the mapping only.
    """
    merged = evidence.groupBy("question_id", "evidence_kind", "evidence_id").agg(F.array_join(F.array_sort(F.collect_set("path_id")), "|").alias("occurrences"), F.count_distinct("path_id").alias("packages"))
    named = merged.join(question_codes(questions, seed), "question_id")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws("\u0000", "question_code", "evidence_kind", "evidence_id")), 256)
    rows = number_rows(named, digest, "question_code", "evidence_kind", "evidence_id").withColumn("row_code", F.format_string("EV-%07d", "number"))
    return rows.select("row_code", "question_code", "evidence_kind", "evidence_id", "packages", joined_hash("row_code", "question_code", "evidence_kind", "evidence_id").alias("identity_sha256"), "occurrences")


def blinded_export(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what annotators see, the key to the paths) of blinded_rows, to be written to two places: only the key knows the occurrences."""
    return rows.drop("occurrences"), rows.select("row_code", "identity_sha256", F.explode(F.split("occurrences", r"\|")).alias("path_id"))


def candidate_structures(sections: DataFrame, items: DataFrame, edges: DataFrame) -> DataFrame:
    """What questions could be built on each section: itself, its parent or a table, or a section it relates to.

    candidate_id is a hash of domain, category and all evidence ids in order; nothing is retrieved.
    """
    base = sections.where("domain is not null").select("source_id", "domain", F.col("document_id").alias("source_group_id"))
    kinds = [base.select("source_id", F.lit("direct_clause").alias("category"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("other"))]
    for kind, category, ordinal in (("immediate_parent", "parent_heading_context", 1), ("table", "table_related", 2)):
        kinds.append(items.where(F.col("context_type") == kind).select(F.col("seed_source_id").alias("source_id"), F.lit(category).alias("category"), F.lit(ordinal).alias("ordinal"), F.col("source_id").alias("other")))
    kinds.append(edges.where("confidence >= 0.85").select("source_id", F.lit("citation_dependency").alias("category"), F.lit(3).alias("ordinal"), F.col("target_id").alias("other")))
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    ids = F.concat_ws("|", "source_id", "other")
    return rows.join(base, "source_id").select(
        joined_hash("domain", "category", "source_id", "other", length=20).alias("candidate_id"), "domain", "category", "ordinal", "source_group_id", "source_id", ids.alias("evidence_ids")
    ).distinct()


def select_structures(structures: DataFrame, limit: int = 10) -> DataFrame:
    """For each category the first `limit` structures in order of source, one from each source group."""
    order = [F.asc("source_id"), F.asc("candidate_id")]
    first = structures.withColumn("_g", F.row_number().over(Window.partitionBy("category", "source_group_id").orderBy(*order))).where("_g = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("place") <= limit).drop("_g")


def scope_candidates(df: DataFrame, key: str, title: str, terms: list[str]) -> DataFrame:
    """(key, matched_terms): records whose title without white space, in lower case, contains a term."""
    plain = F.lower(F.regexp_replace(title, r"\s+", ""))
    wanted = sorted({"".join(t.split()).lower() for t in terms if t.strip()})
    matched = F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(t)), F.lit(t)) for t in wanted]))
    return df.select(F.col(key), F.array_join(matched, "|").alias("matched_terms")).where("matched_terms <> ''")


def recheck_flags(flags: DataFrame, questions: DataFrame) -> DataFrame:
    """What an earlier tool noted on pairs of questions, with the similarity that the texts have.

    A pair given in either order or twice is one row; noted values in percent are brought to the unit interval. agrees: both
    values lie on the same side of 0.85.
    """
    pair = flags.where("question_id is not null and prior_id is not null").select(
        F.least("question_id", "prior_id").alias("a"), F.greatest("question_id", "prior_id").alias("b"), F.when(F.col("normalized_similarity") > 1.0, F.col("normalized_similarity") / 100).otherwise(F.col("normalized_similarity")).alias("noted")
    ).groupBy("a", "b").agg(F.max("noted").alias("noted"))
    texts = questions.select("question_id", normalized("query_text", "question").alias("t"))
    both = pair.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    scored = both.select("a", "b", "noted", block_similarity("ta", "tb").alias("similarity"))
    agrees: Column = (F.col("noted") >= 0.85) == (F.col("similarity") >= 0.85)
    return scored.select("a", "b", F.round("noted", 6).alias("noted"), F.round("similarity", 6).alias("similarity"), agrees.alias("agrees"))
