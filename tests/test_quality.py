import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand import cli
from lodestrand.operators import annotation, quality, routing
from lodestrand.sources import files, sinks
from lodestrand.streaming import ingest


def test_violations_and_redelivery(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", None, "x"), ("b", None, "x"), (None, 1, "x")], "k string, n int, t string")
    assert sorted(tuple(r) for r in quality.violations(df, "e", "k", {"E_N": F.col("n") > 0}).collect()) == [("e", "b", "E_N")]
    assert sorted((r["record_id"], r["deliveries"]) for r in quality.delivered_twice(df, "k").collect()) == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in quality.changed_on_redelivery(df, "k", ("n", "t")).collect()] == [("a", "t")]


def test_import_issues(spark):
    schema = "row string, text string, label string, reason string, hash string"
    base = spark.createDataFrame([(r, "t", None, None, f"h{r}") for r in "abcdefg"], schema)
    rows = [("a", "t", " harmful ", "why", "ha"), ("b", "changed", "CONTEXT", None, "hb"), ("c", "t", "HARMFUL", " ", "hc"), ("d", "t", "nonsense", None, "x"), ("e", "t", "CONTEXT", "why", "he"), ("e", "t", "CONTEXT", "why", "he"), ("z", "t", "CONTEXT", None, "hz"), ("g", "t", "Context", "", "hg")]
    got = quality.import_issues(base, spark.createDataFrame(rows, schema), "row", ("text",), "label", ("CONTEXT", "HARMFUL"), "reason", "HARMFUL", "hash")
    assert sorted(map(tuple, got.collect())) == [("b", "E_FIELD_CHANGED"), ("c", "E_REASON"), ("d", "E_IDENTITY_HASH"), ("d", "E_LABEL"), ("e", "E_REASON"), ("e", "E_ROW_REPEATED"), ("f", "E_ROW_MISSING"), ("z", "E_ROW_UNKNOWN")]


def test_fingerprint_ignores_order(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 7 > 0, "x").alias("b"))
    one = quality.fingerprint(df, ["a", "b"], "t").first()
    two = quality.fingerprint(df.orderBy(F.desc("a")).repartition(7), ["a", "b"], "t").first()
    assert one == two and one["rows"] == 300 and quality.fingerprint(df.where("a <> '5'"), ["a", "b"], "t").first()["sha256"] != one["sha256"]
    assert quality.fingerprint(df.where("false"), ["a", "b"], "t").first()["rows"] == 0


def test_privacy(spark):
    rows = [("1", "API_KEY = abc123"), ("2", "API_KEY = changeme"), ("3", "look in /home/someone/file"), ("4", "maximum_input_tokens: 5"), ("5", "export DB_PASSWORD='hunter2'"), ("6", "C:\\Users\\me"), ("7", "TOKEN=$TOKEN"), ("8", None), ("9", "SECRET: MY_SECRET_NAME"), ("0", "x/home/y/z and a PASSWORD here")]
    got = sorted(tuple(r) for r in quality.privacy_findings(spark.createDataFrame(rows, "p string, t string"), "p", "t").collect())
    assert got == [("1", "possible-secret"), ("3", "absolute-path"), ("5", "possible-secret"), ("6", "absolute-path")]
    names = spark.createDataFrame([("a/.env", 1), ("raw/x.txt", 1), ("d.ZIP", 1), ("ok.py", 10**8), ("fine.py", 1)], "p string, s bigint")
    assert sorted(r["rule"] for r in quality.path_findings(names, "p", "s").collect()) == ["oversize-file", "restricted-directory", "restricted-name", "restricted-suffix"]


def test_chain_and_quotas(spark):
    rows = spark.createDataFrame([("l", 1, "a", None), ("l", 2, "b", "a"), ("l", 3, "c", "x")], "l string, o int, own string, prev string")
    assert [r["o"] for r in quality.chain_breaks(rows, "l", "o", "own", "prev").collect()] == [3]
    counts = quality.quota_counts(spark.createDataFrame([("a",), ("a",), ("c",)], "k string"), spark.createDataFrame([("a", 1), ("b", 2)], "k string, expected int"), ["k"])
    assert sorted(map(tuple, counts.collect())) == [("a", 1, 2), ("b", 2, 0), ("c", 0, 1)]


def test_blinding_hides_paths_and_merges(spark):
    evidence = spark.createDataFrame([("q1", "P0", "ranked", "s1"), ("q1", "P5", "ranked", "s1"), ("q2", "P0", "ranked", "s1")], "question_id string, path_id string, evidence_kind string, evidence_id string")
    rows = annotation.blinded_rows(evidence, evidence.select("question_id")).collect()
    assert sorted(r["row_code"] for r in rows) == ["EV-0000001", "EV-0000002"] and sorted(r["occurrences"] for r in rows) == ["P0", "P0|P5"]
    assert all("P0" not in r["row_code"] + r["question_code"] for r in rows)


def test_scope_and_flags(spark):
    df = spark.createDataFrame([("1", "危险 化学品储存"), ("2", "Other"), ("3", None)], "k string, t string")
    assert [tuple(r) for r in annotation.scope_candidates(df, "k", "t", ["储存", "危险化学品", " "]).collect()] == [("1", "储存|危险化学品")]
    questions = spark.createDataFrame([("a", "the same words"), ("b", "The same, words!"), ("c", None)], "question_id string, query_text string")
    flags = spark.createDataFrame([("a", "b", 97.0), ("b", "a", None), ("a", "c", 0.9), (None, "a", 0.5)], "question_id string, prior_id string, normalized_similarity double")
    got = {(r["a"], r["b"]): (r["noted"], r["similarity"]) for r in annotation.recheck_flags(flags, questions).collect()}
    assert got == {("a", "b"): (0.97, 1.0), ("a", "c"): (0.9, None)}


def test_logistic_optimum_and_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(float)
    w, b = routing.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6
    trees = routing.fit_boosted(x, y)
    score = sum(routing.apply_tree(t, x) for t in trees)
    assert len(trees) == 100 and ((score > 0) == (y > 0.5)).mean() > 0.8


def test_decision():
    gates = {"a": True, "b": True, "c": True}
    assert routing.decision(gates, [True] * 4 + [False])["decision"] == "GO" and routing.decision(gates, [True] * 3 + [False] * 2)["decision"] == "NO-GO" and routing.decision({"a": True}, [True] * 5)["decision"] == "NO-GO"


def test_sinks(tmp_path, spark):
    manifest = sinks.freeze(tmp_path / "f", {"queries": [{"id": 1}]}, {"batch": "b"})
    assert sinks.freeze(tmp_path / "f", {"queries": [{"id": 1}]}, {"batch": "b"}) == manifest
    with pytest.raises(FileExistsError):
        sinks.freeze(tmp_path / "f", {"queries": [{"id": 2}]}, {"batch": "b"})
    ledger = tmp_path / "ledger.jsonl"
    first, second = sinks.ledger_append(ledger, {"why": "x"}), sinks.ledger_append(ledger, {"why": "y"})
    assert second["previous_entry_hash"] == first["entry_hash"]
    ledger.write_text(ledger.read_text().replace('"x"', '"z"'))
    with pytest.raises(ValueError):
        sinks.ledger_append(ledger, {"why": "w"})
    cache = sinks.TableCache(spark, str(tmp_path / "cache"))
    assert cache.get({"a": "1"}) is None and cache.put({"a": "1"}, spark.range(3)).count() == 3 and cache.put({"a": "1"}, spark.range(3)).count() == 3
    with pytest.raises(FileExistsError):
        cache.put({"a": "1"}, spark.range(9))


def test_schema_export(tmp_path):
    first = [p.read_text() for p in sinks.export_schemas(tmp_path, {"nodes": files.NODES, "chunks": files.CHUNKS})]
    assert first == [p.read_text() for p in sinks.export_schemas(tmp_path, {"chunks": files.CHUNKS, "nodes": files.NODES})] and "chunk_id" in first[0]


def test_file_sources(tmp_path, spark):
    (tmp_path / "a_enriched.json").write_text('[{"chunk_id": "c1", "doc_id": "A", "heading": "h", "parents_context": "p", "content": "x"}, {"chunk_id": "c2", "doc_id": "A", "content": "y"}, {"chunk_id": "c3", "doc_id": "B", "content": null}]')
    (tmp_path / "a_tables.json").write_text('[{"chunk_id": "c1", "table": " ", "table_summary": ""}, {"chunk_id": "c1", "table": "t", "table_summary": "sum"}, {"chunk_id": "zz", "table": "t"}]')
    (tmp_path / "nodes.jsonl").write_text('{"id": "n1", "label": "DocChunk", "properties": {"chunk_id": "c1"}}\n\n{"id": "dA", "label": "Doc", "properties": {"doc_id": "A"}}\n{"id": "dB", "label": "Doc", "properties": {"doc_id": "B"}}\n')
    (tmp_path / "edges.jsonl").write_text('{"source": "n1", "target": "dB", "relation": "REFERENCES"}\n{"source": "n1", "target": "dA", "relation": "REFERENCES"}\n{"source": "dA", "target": "dB", "relation": "INTERPRETS"}\n{"source": "n1", "target": "dB", "relation": "OTHER"}\n')
    chunks = files.read_json_lists(spark, str(tmp_path / "*_enriched.json"), files.CHUNKS)
    assert files.corpus_issues(chunks, 3).count() == 0 and [r["code"] for r in files.corpus_issues(chunks, 4).collect()] == ["E_RECORD_COUNT"]
    sections = files.sections_of_chunks(chunks)
    items = files.context_of_chunks(sections, files.read_json_lists(spark, str(tmp_path / "*_tables.json"), files.TABLES))
    assert sorted(r["context_id"] for r in items.collect()) == ["c1:heading_path", "c1:immediate_parent", "c1:table:2"]
    edges = files.edges_of_graph(files.read_json_lines(spark, str(tmp_path / "nodes.jsonl"), files.NODES), files.read_json_lines(spark, str(tmp_path / "edges.jsonl"), files.EDGES), sections)
    assert sorted((r["source_id"], r["target_id"], r["relation"]) for r in edges.collect()) == [("c1", "c3", "CITES"), ("c1", "c3", "DEPENDS_ON"), ("c2", "c3", "DEPENDS_ON")]
    assert [r["key"] for r in files.unknown_keys(spark, str(tmp_path / "edges.jsonl"), files.NODES).select("key").distinct().orderBy("key").collect()] == ["relation", "source", "target"]
    first = files.directory_hash(spark, str(tmp_path))
    (tmp_path / "new.txt").write_text("x")
    assert files.directory_hash(spark, str(tmp_path)) != first


def test_streams(tmp_path, spark):
    rows = spark.createDataFrame([("a", "2025-01-01 00:00:00", 1.0), ("a", "2025-01-01 10:00:00", 2.0), ("b", "2025-01-02 00:00:00", 4.0)], "k string, at string, v double").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    counted = ingest.run_available(ingest.windowed_counts(ingest.read_arrivals(spark, str(tmp_path / "in")), "at", "k", "v"))
    assert sorted((r["k"], r["rows"], r["total"]) for r in counted.collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    once = ingest.run_available(ingest.first_deliveries(ingest.read_arrivals(spark, str(tmp_path / "in")), "k", "at"), "append")
    assert sorted(r["k"] for r in once.collect()) == ["a", "b"]


def test_command_line(capsys):
    assert cli.main(["queries"]) == 0 and "bm25_top50" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "x", "y"]) == 2
