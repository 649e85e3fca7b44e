"""Contracts with a planted violation of each code, and what stands around them."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text
from lodestrand.operators import annotation, contracts, outcomes, quality, retrieval, structure
from lodestrand.plans import catalogue
from lodestrand.sources import sinks


def codes(df, rules, key="k"):
    return sorted((r["record_id"], r["code"]) for r in quality.violations(df, "e", key, rules).collect())


def test_specifications(spark):
    rows = [("ok", ["a"], ["b"], False), ("twice", ["a", "a"], [], False), ("both", ["a"], ["a"], False), ("none", [], [], False), ("extra", ["a"], [], True), ("empty", [], [], True), ("many", [], [str(i) for i in range(21)], False)]
    df = spark.createDataFrame(rows, "k string, required_source_ids array<string>, sufficient_source_ids array<string>, insufficiency_candidate boolean")
    assert codes(df, contracts.specification_rules()) == [("both", "E_ROLE_OVERLAP"), ("extra", "E_INSUFFICIENT_WITH_EVIDENCE"), ("many", "E_SUFFICIENT_IDS"), ("none", "E_EVIDENCE_MISSING"), ("twice", "E_REQUIRED_IDS")]


def test_units_sidecars_and_runs(spark):
    unit = "k string, source_id string, rank int, bm25_rank int, reranker_score double, origin string, graph_seed_source_id string, relation string, confidence double"
    rows = [
        ("ok", "s", 1, 1, None, "direct", None, None, None), ("graph", "s", 2, 1, None, "graph", "t", "CITES", 0.9), ("deep", "s", 11, 51, 1.5, "direct", None, None, None), ("bare", "s", 1, 1, None, "graph", None, "CITES", 0.9),
        ("led", "s", 1, 1, None, "direct", "t", "LIKES", 1.5), ("odd", "", 1, 1, float("nan"), "else", None, None, None),
    ]
    assert codes(spark.createDataFrame(rows, unit), contracts.unit_rules()) == [
        ("bare", "E_GRAPH_FIELDS"), ("deep", "E_BM25_RANK"), ("deep", "E_RANK"), ("deep", "E_RERANKER_SCORE"), ("led", "E_CONFIDENCE"), ("led", "E_GRAPH_FIELDS"), ("led", "E_RELATION"),
        ("odd", "E_GRAPH_FIELDS"), ("odd", "E_RERANKER_SCORE"), ("odd", "E_SOURCE_ID"),
    ]
    cars = spark.createDataFrame([("ok", "c", 1, 3, "table"), ("bad", None, 6, 4, "note")], "k string, sidecar_id string, seed_rank int, order_within_seed int, context_type string")
    assert [c for _, c in codes(cars, contracts.sidecar_rules())] == ["E_CONTEXT_TYPE", "E_ORDER_WITHIN_SEED", "E_SEED_RANK", "E_SIDECAR_ID"]
    run = "k string, status string, error_code string, ranked_source_ids array<string>, sidecar_ids array<string>, context_items_attached int, graph_targets_inserted int"
    rows = [("ok", "complete", None, ["a"], [], 0, 0), ("failed", "execution_error", "E_X", [], [], 0, 0), ("silent", "execution_error", None, ["a"], [], 0, 0), ("long", "complete", None, ["a"] * 11, ["c"], 2, 6), ("odd", "else", None, [], [], 0, 0)]
    assert codes(spark.createDataFrame(rows, run), contracts.run_rules()) == [("long", "E_GRAPH_TARGETS"), ("long", "E_SIDECARS"), ("long", "E_UNITS"), ("odd", "E_STATUS"), ("silent", "E_ERROR_CODE"), ("silent", "E_FAILED_WITH_UNITS")]


def test_authoring_and_searches(spark):
    schema = "k string, review_decision string, construction_category string, source_resolution_checked boolean, prior_question_check string, manual_search_record_id string, reviewed_by string, reviewed_at string"
    rows = [
        ("ok", "accept", "direct_clause", True, "clear", None, "r", "t"), ("draft", "draft", "direct_clause", False, "pending", None, None, None), ("half", "draft", "direct_clause", False, "pending", None, "r", None),
        ("hasty", "accept", "evidence_insufficient", False, "pending", None, None, None), ("placed", "draft", "table_related", False, "pending", "m", None, None),
    ]
    assert codes(spark.createDataFrame(rows, schema), contracts.authoring_rules()) == [
        ("half", "E_REVIEWER"), ("hasty", "E_ACCEPTED_UNREVIEWED"), ("hasty", "E_PRIOR_CHECK"), ("hasty", "E_SEARCH_MISSING"), ("hasty", "E_SOURCES_UNCHECKED"), ("placed", "E_SEARCH_OUT_OF_PLACE"),
    ]
    schema = "k string, search_methods array<string>, query_terms array<string>, search_scope string, rationale string, evidence_found boolean, conclusion string"
    rows = [("ok", ["title_lookup"], ["a", "b"], "x" * 10, "y" * 10, False, contracts.INSUFFICIENT), ("bad", ["guess"], ["a ", "A"], "x", "y", True, contracts.INSUFFICIENT)]
    assert [c for _, c in codes(spark.createDataFrame(rows, schema), contracts.search_rules())] == ["E_CONCLUSION", "E_METHODS", "E_RATIONALE", "E_SCOPE", "E_TERMS"]


def test_corpus_identity(spark):
    schema = "domain string, corpus_hash string, record_count bigint, source_revision string"
    actual = spark.createDataFrame([("a", "h", 1, None), ("b", "h", 2, "r"), ("c", "h", 1, "r")], schema)
    expected = spark.createDataFrame([("a", "h", 1, None), ("b", "x", 3, None), ("d", "h", 1, "r")], schema)
    assert sorted(map(tuple, contracts.corpus_mismatches(actual, expected).collect())) == [("b", "corpus_hash"), ("b", "record_count"), ("b", "source_revision"), ("c", "domain"), ("d", "domain")]


SECTIONS = "source_id string, domain string, document_id string, heading string, content string, source_type string, section_number string"


def test_authoring_issues(spark):
    sections = spark.createDataFrame([
        ("s1", "chemical", "D", "1 Scope", "see clause 2", "section", "1"), ("s2", "chemical", "D", None, "", "section", "2"), ("s11", "chemical", "D", "1.1 Part", "", "section", "1.1"),
        ("n1", "chemical", "D", "Note", "", "table_note", None), ("x1", "pharmaceutical", "E", "1 Other", "", "section", "1"),
    ], SECTIONS)
    questions = spark.createDataFrame([
        ("none", "chemical", "direct_clause", [], "t"), ("lost", "chemical", "direct_clause", ["zz", None], "t"), ("crossed", "chemical", "direct_clause", ["x1"], "t"), ("fine", "chemical", "direct_clause", ["s1"], "t"), ("indirect", "chemical", "direct_clause", ["s1"], "t"),
        ("table", "chemical", "table_related", ["s1"], "t"), ("no table", "chemical", "table_related", ["s1"], "t"), ("graph", "chemical", "citation_dependency", ["s1"], "t"), ("no graph", "chemical", "citation_dependency", ["s1"], "t"),
        ("parent", "chemical", "parent_heading_context", ["s11"], "t"), ("no parent", "chemical", "parent_heading_context", ["s2"], "t"), ("free", "chemical", "evidence_insufficient", [], "t"), ("far", "chemical", None, ["s2"], "t"),
    ], "question_id string, domain string, category string, authoring_source_ids array<string>, query_text string")
    evidence = spark.createDataFrame([
        ("fine", "s1"), ("indirect", "s2"), ("table", "n1"), ("no table", "s1"), ("graph", "s2"), ("no graph", "s1"), ("parent", "s1"), ("no parent", "s2"), ("far", "x1"),
    ], "question_id string, source_id string")
    got = quality.authoring_issues(questions, sections, structure.relation_edges(sections), evidence)
    assert sorted(map(tuple, got.collect())) == [
        ("crossed", "E_AUTHORING_SOURCE_DOMAIN"), ("far", "E_EVIDENCE_SOURCE_UNRESOLVED"), ("indirect", "E_DIRECT_STRUCTURE"), ("lost", "E_AUTHORING_SOURCE_UNRESOLVED"),
        ("no graph", "E_GRAPH_STRUCTURE"), ("no parent", "E_CONTEXT_STRUCTURE"), ("no table", "E_TABLE_STRUCTURE"), ("none", "E_AUTHORING_SOURCE_MISSING"),
    ]


def test_every_table_of_a_document_is_context(spark):
    rows = [("s", "chemical", "D", "1 Scope", "", "section", "1")] + [(f"n{k:02d}", "chemical", "D", "", "", "table_note", None) for k in range(10)]
    sections = spark.createDataFrame(rows, SECTIONS)
    seeds = sections.where("source_id = 's'")
    of = lambda **given: structure.context_items(seeds, sections, **given).where("context_type = 'table'").count()
    assert of() == 10 and of(most_notes=4) == 4


def test_all_counts_questions_without_a_domain(spark):
    rows = [("q1", "P0", "d", "c", True, False, True, 1), ("q2", "P0", None, "c", False, True, False, 3)]
    df = spark.createDataFrame(rows, "question_id string, path_id string, domain string, category string, evidence_complete boolean, harmful_expansion boolean, combined_path_success boolean, context_items_attached bigint")
    got = {r["domain"]: r["question_path_count"] for r in outcomes.outcome_summary(df).collect()}
    assert got == {"all": 2, "d": 1, None: 1}


def test_cues_in_compatibility_forms(spark):
    df = spark.createDataFrame([("a", "see the ＴＡＢＬＥ here", [10.0, 1.0])], "question_id string, query_text string, scores array<double>")
    assert outcomes.heuristic_policy(df.drop("scores"), df.drop("query_text")).first()["selected_path_id"] == "P2"


def test_runs_that_break_their_path(spark):
    units = spark.createDataFrame([("q", "P0", 1, "a", "direct"), ("q", "P0", 3, "a", "graph"), ("q", "P5", 1, "a", "direct")], "question_id string, path_id string, rank int, source_id string, origin string")
    cars = spark.createDataFrame([("q", "P0", "c"), ("q", "P0", "c"), ("q", "P5", "c")], "question_id string, path_id string, sidecar_id string")
    got = sorted(r["code"] for r in structure.run_issues(units, cars).collect())
    assert got == ["E_EVIDENCE_ID_DUPLICATE", "E_PATH_CONTEXT_FORBIDDEN", "E_PATH_GRAPH_FORBIDDEN", "E_RANK_SEQUENCE", "E_SIDECAR_ID_DUPLICATE"]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 5.0, 5.0, 9.0], [1.0, 1e9, 2.0, 3.0, 2.5], list(range(1001))])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([("P0", float(v)) for v in values] + [("P0", None), ("P0", float("nan")), ("zz", 1.0)], "path_id string, runtime_ms double")
    ordered = sorted(map(float, values))
    n = len(ordered)
    assert outcomes.path_costs(df).first()["median_runtime_ms"] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_any_model_reranks_in_batches(spark):
    pairs = spark.createDataFrame([("q", f"d{k}", "alpha" if k else None, "x" * k) for k in range(20)], "question_id string, source_id string, q string, d string")

    def load():
        return lambda texts: [min(1.0, len(d) / 20) for _, d in texts]

    got = {r["source_id"]: r["reranker_score"] for r in retrieval.rerank_scores(pairs, load, ["question_id", "source_id"], "q", "d").collect()}
    assert got == {f"d{k}": k / 20 for k in range(20)}
    with pytest.raises(Exception, match="one number in"):
        retrieval.rerank_scores(pairs, lambda: lambda texts: [2.0] * len(texts), ["question_id", "source_id"], "q", "d").collect()
    before = spark.createDataFrame([("q", "a"), ("q", "b")], "question_id string, source_id string")
    after = spark.createDataFrame([("q", "a", 0.5), ("q", "a", 0.4), ("q", "z", None)], "question_id string, source_id string, reranker_score double")
    assert sorted(r["code"] for r in retrieval.rerank_issues(before, after).collect()) == ["E_EVIDENCE_ID_DUPLICATE", "E_RERANKER_SCORE", "E_SOURCE_ADDED", "E_SOURCE_LOST"]
    assert retrieval.rerank_issues(before, before.withColumn("reranker_score", F.lit(0.1))).count() == 0


def test_export_knows_no_paths_and_key_does(spark):
    evidence = spark.createDataFrame([("q1", "P0", "ranked", "s1"), ("q1", "P5", "ranked", "s1")], "question_id string, path_id string, evidence_kind string, evidence_id string")
    seen, key = annotation.blinded_export(annotation.blinded_rows(evidence, evidence.select("question_id")))
    assert "occurrences" not in seen.columns and sorted(r["path_id"] for r in key.collect()) == ["P0", "P5"]


def test_cache_refuses_other_rows(spark, tmp_path):
    cache = sinks.TableCache(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    cache.put({"v": "1"}, df)
    assert cache.put({"v": "1"}, df.orderBy(F.desc("k"))).count() == 2
    with pytest.raises(FileExistsError):
        cache.put({"v": "1"}, df.where("n = 1"))


def test_rounding_and_first_filled(spark):
    df = spark.createDataFrame([(0.5, None, " x "), (1.5, " ", "y"), (2.5, "a", None)], "n double, a string, b string")
    assert [tuple(r) for r in df.select(text.half_even("n", 0), text.first_filled("a", "b")).collect()] == [(0.0, "x"), (2.0, "y"), (2.0, "a")]


@pytest.mark.parametrize(("name", "unread"), [("fold_assignment", "query_text"), ("stratified_sample", "query_text"), ("graph_metadata", "provenance"), ("category_quotas", "query_text")])
def test_scans_read_only_what_is_used(spark, name, unread):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert unread not in plan
