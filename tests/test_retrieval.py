import math
import random
from collections import Counter

import pytest

from lodestrand.operators import retrieval, structure
from lodestrand.plans import retrieval as plans

UNITS = "question_id string, source_id string, bm25_rank int, bm25_score double, reranker_score double, rank int"


def brute_bm25(queries, docs, k):
    out = {}
    for scope, q, terms in queries:
        mine = [(d, t) for s, d, t in docs if s == scope]
        n, avg = len(mine), sum(len(t) for _, t in mine) / max(1, len(mine))
        df = Counter(w for _, t in mine for w in set(t))
        scores = []
        for d, t in mine:
            tf = Counter(t)
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w, c in Counter(terms).items() if tf[w])
            if s > 0:
                scores.append((-round(s, 6), d))
        out |= {(q, r): d for r, (_, d) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["join", "blocks"])
def test_bm25_equals_the_formula(spark, kind):
    random.seed(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(random.choice("ab"), f"d{i:03d}", [random.choice(words[: random.randrange(2, 30)]) for _ in range(random.randrange(0, 20))]) for i in range(120)]
    queries = [(random.choice("abc"), f"q{i}", [random.choice(words) for _ in range(random.randrange(0, 6))]) for i in range(30)]
    d = spark.createDataFrame(docs, "scope string, doc string, terms array<string>")
    q = spark.createDataFrame(queries, "scope string, query string, terms array<string>")
    found = retrieval.bm25_top(q, d, "scope", "query", "doc", "terms", 7) if kind == "join" else retrieval.bm25_top_blocked(q, d, "scope", "query", "doc", "terms", 7, block=16)
    assert {(r["query"], r["rank"]): r["doc"] for r in found.collect()} == brute_bm25(queries, docs, 7)
    with pytest.raises(ValueError):
        retrieval.bm25_top(q, d, "scope", "query", "doc", "terms", 0)


def test_rerank_order_and_issues(spark):
    rows = [("q", "S-A", 1, 1.0, 0.5, 1), ("q", "S-B", 2, 1.0, 0.5, 2), ("q", "S-C", 3, 1.0, 0.9, 3), ("q", "S-D", 4, 1.0, None, 4)]
    got = retrieval.rerank(spark.createDataFrame(rows, UNITS).drop("rank")).orderBy("rank").collect()
    assert [r["source_id"] for r in got] == ["S-C", "S-A", "S-B", "S-D"]
    bad = [("q", "S-A", 1), ("q", "S-A", 3), ("r", "x", 1), ("r", "y", 2)]
    issues = retrieval.first_stage_issues(spark.createDataFrame(bad, "question_id string, source_id string, bm25_rank int")).collect()
    assert sorted((r["question_id"], r["code"]) for r in issues) == [("q", "E_EVIDENCE_ID_DUPLICATE"), ("q", "E_RANK_SEQUENCE")]


def test_expansion_keeps_seeds_then_targets_then_rest(spark):
    units = spark.createDataFrame([("q", f"S{i:02d}", i, 20.0 - i, None, i) for i in range(1, 11)], UNITS)
    edges = spark.createDataFrame([("S02", "G02", "DEPENDS_ON", 0.95), ("S01", "G01", "CITES", 0.90), ("S01", "S08", "CITES", 0.99), ("S01", "G00", "CITES", 0.80)], "source_id string, target_id string, relation string, confidence double")
    got = structure.expand_one_hop(units, edges).orderBy("rank").collect()
    assert [r["source_id"] for r in got] == ["S01", "S02", "S03", "S04", "S05", "G01", "G02", "S06", "S07", "S08"]
    assert got[5]["bm25_rank"] == 1 and got[5]["origin"] == "graph"
    assert structure.expand_one_hop(units.where("rank <= 3"), edges.where("false")).count() == 3


def test_context_is_bounded_and_ordered(spark):
    rows = [("s1", "chemical", "D", "2.1 Parts", "x", "section", "2.1"), ("s0", "chemical", "D", "2 All", "x", "section", "2")] + [(f"t{i}", "chemical", "D", "", "x", "table_note", None) for i in range(6)]
    sections = spark.createDataFrame(rows, "source_id string, domain string, document_id string, heading string, content string, source_type string, section_number string")
    units = spark.createDataFrame([("q", "s1", 1, 1.0, None, 1)], UNITS)
    got = structure.sidecars(units, structure.context_items(units, sections)).orderBy("order_within_seed").collect()
    assert [(r["context_type"], r["source_id"]) for r in got] == [("heading_path", "s1"), ("immediate_parent", "s0"), ("table", "t0")]


def test_edges_resolve_unique_numbers_only(spark):
    rows = [("a", "D", "1.1", "见第2条和第3.1条 clause 9.9"), ("b", "D", "2", ""), ("c", "D", "3.1", ""), ("d", "D", "3.1", ""), ("e", "D", "1", "第1条"), ("f", None, "7", "第2条"), ("g", "E", "9", "clause 9.9")]
    sections = spark.createDataFrame(rows, "source_id string, document_id string, section_number string, content string")
    got = sorted((r["source_id"], r["target_id"], r["relation"], r["confidence"]) for r in structure.relation_edges(sections).collect())
    assert got == [("a", "b", "CITES", 0.95), ("a", "e", "DEPENDS_ON", 0.9)]


def test_run_issues(spark):
    units = spark.createDataFrame([("q", "P0", 1, "a", "direct"), ("q", "P0", 2, "b", "graph"), ("q", "P3", 2, "a", "graph")], "question_id string, path_id string, rank int, source_id string, origin string")
    cars = spark.createDataFrame([("q", "P0", "x"), ("q", "P0", "x")], "question_id string, path_id string, sidecar_id string")
    got = sorted((r["path_id"], r["code"]) for r in structure.run_issues(units, cars).collect())
    assert got == [("P0", "E_PATH_CONTEXT_FORBIDDEN"), ("P0", "E_PATH_GRAPH_FORBIDDEN"), ("P0", "E_SIDECAR_ID_DUPLICATE"), ("P3", "E_RANK_SEQUENCE")]


def test_contracts_see_candidates_as_delivered(spark, tmp_path):
    at = "timestamp'2025-01-01'"
    rows = [(1, "q", "chemical", "a", 1), (2, "q", "chemical", "a", 2), (3, "q", "chemical", "b", 3), (3, "q", "chemical", "b", 3), (4, "r", "Chemical", "a", 1), (5, "r", "chemical", "p", 2), (6, "s", "chemical", "a", 1), (7, "s", "chemical", "b", 2), (8, "t", "chemical", "a", 1), (9, "t", "chemical", "b", 3), (10, None, "chemical", "b", 3)]
    c = spark.createDataFrame(rows, "candidate_id bigint, question_id string, domain string, source_id string, rank int")
    c.selectExpr("*", "1d as score", "1d as reranker_score", f"{at} as ingested_at").write.parquet(f"{tmp_path}/retrieval_candidates.parquet")
    s = spark.createDataFrame([("a", "chemical"), ("b", "chemical"), ("p", "pharmaceutical")], "source_id string, domain string")
    s.selectExpr("*", "'' as document_id", "'' as heading", "'' as content", "'' as source_type", "'' as runtime_locator", f"{at} as ingested_at").write.parquet(f"{tmp_path}/source_sections.parquet")
    q = spark.createDataFrame([(x, "chemical") for x in "qrst"], "question_id string, domain string")
    q.selectExpr("*", "'' as construction_category", "'zh' as language", "'' as query_text", "'' as source_group_id", "array('a') as authoring_source_ids", f"{at} as ingested_at").write.parquet(f"{tmp_path}/queries.parquet")
    got = sorted((r["question_id"], r["code"]) for r in plans.first_stage_delivered_issues(spark, str(tmp_path)).collect())
    assert got == [("q", "E_EVIDENCE_ID_DUPLICATE"), ("r", "E_DOMAIN"), ("t", "E_RANK_SEQUENCE")]
    got = sorted((r["question_id"], r["code"]) for r in plans.path_run_delivered_issues(spark, str(tmp_path)).collect())
    assert got == [("q", "E_EVIDENCE_ID_DUPLICATE"), ("t", "E_RANK_SEQUENCE")]
