"""Queries over record contracts, annotation exports, corpus identity and privacy, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import slug as slugged
from lodestrand.operators import annotation, contracts, quality, structure
from lodestrand.plans import sql
from lodestrand.plans.evaluation_sql import ANN, OUTCOMES
from lodestrand.plans.retrieval import Inputs, path_sidecars, path_units
from lodestrand.session import table
from lodestrand.sources import tables

TERMS = ["运行管理", "储存要求", "应急 处置", "Cleaning validation", "storage"]


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four tables that break a rule of theirs."""
    q = table(spark, sf_dir, "queries")
    a = tables.annotations(spark, sf_dir)
    s = table(spark, sf_dir, "source_sections")
    c = table(spark, sf_dir, "retrieval_candidates")
    language = F.lower(F.trim("language"))
    domain = slugged("domain")
    parts = [
        quality.violations(q, "query", "question_id", {
            "E_ID": quality.identifier("question_id"), "E_TEXT": F.length(F.trim("query_text")).between(3, 1000), "E_LANGUAGE": ((domain == "chemical") & (language == "zh")) | ((domain == "pharmaceutical") & (language == "en")),
            "E_GROUP": F.col("source_group_id").isNotNull(), "E_SOURCES": quality.unique_items("authoring_source_ids"),
        }),
        quality.violations(a, "annotation", "annotation_id", {
            "E_REASON": (F.col("label") == "HARMFUL") == F.col("harmful_reason_code").isNotNull(), "E_OFFSET": F.col("annotated_at_offset").rlike(r"^[+-][0-9]{2}:[0-9]{2}$"), "E_ROLE": F.col("role").isin("primary", "duplicate", "adjudicated"),
        }),
        quality.violations(s, "section", "source_id", {"E_HEADING": F.length(F.trim("heading")) > 0, "E_CONTENT": F.length(F.trim("content")) > 0, "E_PROVENANCE": F.size("provenance") >= 1}),
        quality.violations(c, "candidate", "candidate_id", {"E_QUESTION": F.col("question_id").isNotNull(), "E_RANK": F.col("rank") >= 1, "E_SCORE": tables.finite("score").isNotNull(), "E_RERANKER": tables.finite("reranker_score").between(0, 1)}),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("entity", "code").agg(F.count(F.lit(1)).alias("records"))


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each table were delivered more than once."""
    keys = {"queries": "question_id", "source_sections": "source_id", "retrieval_candidates": "candidate_id", "evidence_annotations": "annotation_id"}
    return reduce(DataFrame.unionByName, [quality.delivered_twice(table(spark, sf_dir, t), k).select(F.lit(t).alias("table_name"), "deliveries") for t, k in keys.items()]).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("records"), F.sum("deliveries").alias("rows"))


def redelivery_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of annotations that changed between deliveries."""
    return quality.changed_on_redelivery(table(spark, sf_dir, "evidence_annotations"), "annotation_id", ("question_id", "path_id", "evidence_id", "evidence_kind", "label", "annotator_code", "harmful_reason_code"))


def dataset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that only the questions or only the frozen batches have."""
    folds = table(spark, sf_dir, "fold_partitions")
    listed = reduce(DataFrame.unionByName, [folds.select(F.explode(c).alias("question_id")) for c in ("train_question_ids", "calibration_question_ids", "test_question_ids")])
    return quality.one_sided(table(spark, sf_dir, "queries"), listed, "question_id").select("question_id", F.when(F.col("side") == "left", "queries_only").otherwise("batches_only").alias("code"))


def category_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each cell against the rows that the targets want."""
    goals = table(spark, sf_dir, "sample_targets").select("domain", F.col("construction_category").alias("category"), F.col("target_rows").cast("bigint").alias("expected"))
    known = tables.questions(spark, sf_dir, "domain", "category").where("domain is not null and category is not null")
    return quality.quota_counts(known, goals, ["domain", "category"])


def annotation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated questions and annotated evidence that the tables lack."""
    labels = tables.annotations(spark, sf_dir)
    q = labels.select("question_id").distinct().join(tables.questions(spark, sf_dir, "domain"), "question_id", "left_anti").select(F.col("question_id").alias("record_id"), F.lit("E_QUESTION_UNKNOWN").alias("code"))
    s = labels.select(F.col("evidence_id").alias("source_id")).distinct().join(tables.sections(spark, sf_dir, "domain"), "source_id", "left_anti").select(F.col("source_id").alias("record_id"), F.lit("E_EVIDENCE_UNKNOWN").alias("code"))
    return q.unionByName(s)


def authoring_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose authoring sources can't be resolved, are of another domain, or lack the structure that their category needs."""
    q = tables.questions(spark, sf_dir, "domain", "category", "query_text", "authoring_source_ids")
    s = tables.sections(spark, sf_dir, "domain", "document_id", "heading", "content", "source_type", "section_number")
    cited = tables.final_labels(spark, sf_dir).where(F.col("label").isin("REQUIRED", "SUFFICIENT"))
    evidence = cited.select("question_id", F.regexp_extract("evidence_id", "^([^:]*)", 1).alias("source_id"))
    return quality.authoring_issues(q, s, structure.relation_edges(s), evidence)


def specification_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken contracts of the evidence that final labels require of each question, or find sufficient."""
    labels = tables.final_labels(spark, sf_dir)
    of = lambda label: F.collect_set(F.when(F.col("label") == label, F.col("evidence_id")))
    sets = labels.groupBy("question_id").agg(of("REQUIRED").alias("required_source_ids"), of("SUFFICIENT").alias("sufficient_source_ids"))
    q = tables.questions(spark, sf_dir, "category").select("question_id", F.coalesce(F.col("category") == "evidence_insufficient", F.lit(False)).alias("insufficiency_candidate"))
    return quality.violations(sets.join(q, "question_id"), "specification", "question_id", contracts.specification_rules())


def run_contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken contracts of the units and sidecars of all six paths, counted by path and code."""
    inputs = Inputs(spark, sf_dir, kept=True)
    parts = []
    for p, modules in structure.MODULES.items():
        parts.append(quality.violations(path_units(p, inputs).withColumn("key", F.concat_ws("/", "question_id", "rank")), p, "key", contracts.unit_rules()))
        if modules[1]:
            parts.append(quality.violations(path_sidecars(p, inputs).withColumn("key", F.concat_ws("/", "question_id", "sidecar_id")), p, "key", contracts.sidecar_rules()))
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("entity").alias("path_id"), "code").agg(F.count(F.lit(1)).alias("records"))


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each path: ranked evidence with and without a label, and labels without ranked evidence."""
    inputs = Inputs(spark, sf_dir, kept=True)
    units = reduce(DataFrame.unionByName, [path_units(p, inputs).select("question_id", F.lit(p).alias("path_id"), F.col("source_id").alias("evidence_id"), F.lit(1).alias("u")) for p in structure.MODULES])
    labels = tables.final_labels(spark, sf_dir).where("evidence_kind = 'ranked'").select("question_id", "path_id", "evidence_id", F.lit(1).alias("l"))
    both = units.join(labels, ["question_id", "path_id", "evidence_id"], "full")
    return both.groupBy("path_id").agg(F.count_if(F.col("u").isNotNull() & F.col("l").isNotNull()).alias("labelled"), F.count_if(F.col("l").isNull()).alias("unlabelled"), F.count_if(F.col("u").isNull()).alias("unused_labels"))


def blinded_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that annotators would see, and the key to their paths."""
    return annotation.blinded_rows(tables.final_labels(spark, sf_dir), tables.questions(spark, sf_dir, "domain"))


def candidate_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structures selected for each category."""
    sections = tables.sections(spark, sf_dir, "domain", "document_id", "heading", "content", "source_type", "section_number")
    found = annotation.candidate_structures(sections, structure.context_items(sections, sections, structure.SIDECARS + 1), structure.relation_edges(sections))
    return annotation.select_structures(found)


def scope_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose heading names a term of the scope."""
    return annotation.scope_candidates(tables.sections(spark, sf_dir, "heading"), "source_id", "heading", TERMS)


def prior_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noted similarities of pairs of questions against those of their texts."""
    return annotation.recheck_flags(table(spark, sf_dir, "prior_question_flags"), tables.questions(spark, sf_dir, "query_text"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of the corpus: sections and edges."""
    sections = tables.sections(spark, sf_dir, "domain", "document_id", "heading", "content", "section_number")
    parts = {"sections": (sections, ["source_id", "domain", "document_id", "heading", "content"]), "edges": (structure.relation_edges(sections), ["source_id", "target_id", "relation"])}
    return quality.fingerprints(parts)


def rotation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen rows whose outer_test_fold isn't the calibration fold of the row before them in their batch."""
    once = table(spark, sf_dir, "fold_partitions").select("batch_id", "outer_test_fold", "calibration_fold").distinct()
    links = once.withColumn("expected", F.when(F.col("outer_test_fold") > 0, F.col("outer_test_fold")))
    return quality.chain_breaks(links, "batch_id", "outer_test_fold", "calibration_fold", "expected").select("batch_id", "outer_test_fold")


def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with machine-local paths, credential-like assignments or too much text."""
    return quality.privacy_findings(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        contract_violations, redelivered, redelivery_changes, dataset_issues, category_quotas, annotation_questions, authoring_issues, specification_issues, run_contract_issues, label_coverage, blinded_payload, candidate_structures, scope_candidates, prior_flags,
        fingerprint, rotation_chain, privacy_scan,
    )
}


def _rule(entity: str, source: str, key: str, rules: dict[str, str]) -> str:
    each = ", ".join(f"case when not coalesce({ok}, false) then '{code}' end" for code, ok in rules.items())
    return f"select distinct '{entity}' as entity, cast({key} as varchar) as record_id, unnest(list_filter([{each}], lambda x: x is not null)) as code from {source}"


_FIN = "case when isfinite({0}) then {0} end"
_CODES = f"""{sql.QS},
codes as (select question_id, 'Q-' || lpad(cast(row_number() over (order by sha256('20260723:' || question_id), question_id) as varchar), 7, '0') as question_code from qs)"""
SQL = {
    "contract_violations": f"""with {ANN}, flat as (select annotation_id, any_value(annotated_at_offset) as o from evidence_annotations group by 1), v as (
      {_rule("query", "queries", "question_id", {"E_ID": "length(question_id) between 1 and 128", "E_TEXT": "length(trim(query_text, ' ')) between 3 and 1000",
        "E_LANGUAGE": f"({sql.slug('domain')} = 'chemical' and lower(trim(language, ' ')) = 'zh') or ({sql.slug('domain')} = 'pharmaceutical' and lower(trim(language, ' ')) = 'en')", "E_GROUP": "source_group_id is not null",
        "E_SOURCES": "len(list_distinct(authoring_source_ids)) = len(authoring_source_ids) and len(authoring_source_ids) <= 20"})}
      union all {_rule("annotation", "anno join flat using (annotation_id)", "annotation_id", {"E_REASON": "(label = 'HARMFUL') = (reason is not null)", "E_OFFSET": "regexp_matches(o, '^[+-][0-9]{2}:[0-9]{2}$')", "E_ROLE": "role in ('primary', 'duplicate', 'adjudicated')"})}
      union all {_rule("section", "source_sections", "source_id", {"E_HEADING": "length(trim(heading, ' ')) > 0", "E_CONTENT": "length(trim(content, ' ')) > 0", "E_PROVENANCE": "cardinality(provenance) >= 1"})}
      union all {_rule("candidate", "retrieval_candidates", "candidate_id", {"E_QUESTION": "question_id is not null", "E_RANK": "rank >= 1", "E_SCORE": f"({_FIN.format('score')}) is not null", "E_RERANKER": f"({_FIN.format('reranker_score')}) between 0 and 1"})})
      select entity, code, count(*) as records from v group by all""",
    "redelivered": "select table_name, count(*) as records, cast(sum(n) as bigint) as rows from (" + " union all ".join(
        f"select '{t}' as table_name, {k}::varchar as k, count(*) as n from {t} where {k} is not null group by all having count(*) > 1"
        for t, k in (("queries", "question_id"), ("source_sections", "source_id"), ("retrieval_candidates", "candidate_id"), ("evidence_annotations", "annotation_id"))) + ") group by 1",
    "redelivery_changes": """select annotation_id as record_id, unnest(list_filter([""" + ", ".join(f"case when count(distinct coalesce({f}, chr(0))) > 1 then '{f}' end" for f in ("question_id", "path_id", "evidence_id", "evidence_kind", "label", "annotator_code", "harmful_reason_code"))
    + "], lambda x: x is not null)) as field from evidence_annotations where annotation_id is not null group by annotation_id",
    "dataset_issues": """with l as (select distinct unnest(list_concat(list_concat(train_question_ids, calibration_question_ids), test_question_ids)) as question_id from fold_partitions),
      q as (select distinct question_id from queries where question_id is not null)
      select question_id, 'queries_only' as code from q anti join l using (question_id) union all select question_id, 'batches_only' from l anti join q using (question_id) where question_id is not null""",
    "category_quotas": f"""with {sql.QS}, a as (select domain, category, count(*) as actual from qs where domain is not null and category is not null group by all)
      select coalesce(t.domain, a.domain) as domain, coalesce(construction_category, category) as category, coalesce(cast(target_rows as bigint), 0) as expected, coalesce(actual, 0) as actual
      from sample_targets t full join a on t.domain = a.domain and construction_category = category""",
    "annotation_questions": f"""with {ANN} select distinct question_id as record_id, 'E_QUESTION_UNKNOWN' as code from anno anti join queries using (question_id)
      union all select distinct evidence_id, 'E_EVIDENCE_UNKNOWN' from anno where evidence_id not in (select source_id from source_sections where source_id is not null)""",
    "authoring_issues": f"""with {sql.EDGES}, {OUTCOMES},
      a as (select question_id, domain, category, query_text, len(ids) as n, unnest(case when len(ids) > 0 then ids else [null] end) as source_id
            from (select *, list_distinct(list_filter(coalesce(authoring_source_ids, []), lambda x: x is not null)) as ids from qs)),
      r as (select a.*, s.source_id is not null as found, coalesce(s.domain = a.domain, false) as fits, s.document_id, s.section_number, trim(coalesce(s.heading, ''), ' ') <> '' as headed from a left join secs s using (source_id)),
      anchors as (select * from r where n > 0 and found and fits and coalesce(category <> 'evidence_insufficient', true)),
      parents as (select question_id, holder as id from (select question_id, source_id, document_id, {sql.PARENT.format('section_number')} as section_number from anchors) join numbered using (document_id, section_number) where holder <> source_id),
      near_ as (select question_id, source_id as id, 'anchor' as k from anchors union all select question_id, source_id, 'context' from anchors where headed union all select question_id, id, 'context' from parents
        union all select question_id, target_id, 'graph' from anchors join edges using (source_id) where confidence >= 0.85),
      ev as (select distinct question_id, regexp_extract(evidence_id, '^([^:]*)', 1) as id from labels where label in ('REQUIRED', 'SUFFICIENT')),
      tab as (select distinct question_id, e.id from ev e join anchors a using (question_id) join secs n on n.source_id = e.id where n.source_type = 'table_note' and n.document_id = a.document_id and n.source_id <> a.source_id),
      hit as (select question_id, e.id, bool_or(k = 'anchor') as anchor, bool_or(k = 'context') as context, bool_or(k = 'graph') as graph, bool_or(k = 'table') as tabled
        from ev e left join (select * from near_ union all select question_id, id, 'table' from tab) x using (question_id, id) group by all),
      sums as (select question_id, bool_or(coalesce(anchor or context or graph or tabled, false) = false) as missing, bool_and(coalesce(anchor, false)) as direct, bool_or(coalesce(context, false)) as context,
        bool_or(coalesce(graph, false)) as graph, bool_or(coalesce(tabled, false)) as tabled from hit group by 1),
      per as (select question_id, any_value(category) as category, any_value(n) as n, bool_or(n > 0 and not found) as lost, bool_or(found and not fits) as crossed, any_value(sums.missing) as missing, any_value(coalesce(direct, true)) as direct,
        any_value(coalesce(context, false)) as context, any_value(coalesce(graph, false)) as graph, any_value(coalesce(tabled, false)) as tabled from r left join sums using (question_id) where coalesce(category <> 'evidence_insufficient', true) group by 1)
      select question_id, unnest(list_filter([case when n = 0 then 'E_AUTHORING_SOURCE_MISSING' end, case when lost then 'E_AUTHORING_SOURCE_UNRESOLVED' end, case when crossed then 'E_AUTHORING_SOURCE_DOMAIN' end,
        case when n > 0 and coalesce(missing, false) then 'E_EVIDENCE_SOURCE_UNRESOLVED' end, case when n > 0 and category = 'direct_clause' and not direct then 'E_DIRECT_STRUCTURE' end,
        case when n > 0 and category = 'parent_heading_context' and not context then 'E_CONTEXT_STRUCTURE' end, case when n > 0 and category = 'table_related' and not tabled then 'E_TABLE_STRUCTURE' end,
        case when n > 0 and category = 'citation_dependency' and not graph then 'E_GRAPH_STRUCTURE' end], lambda x: x is not null)) as code from per""",
    "specification_issues": f"""with {OUTCOMES},
      s as (select question_id, list(distinct evidence_id) filter (label = 'REQUIRED') as r, list(distinct evidence_id) filter (label = 'SUFFICIENT') as u from labels group by 1),
      x as (select question_id, coalesce(len(r), 0) as nr, coalesce(len(u), 0) as nu, coalesce(len(list_intersect(r, u)), 0) as nb, insufficient from s join specs using (question_id))
      select 'specification' as entity, question_id as record_id, unnest(list_filter([case when nr > 20 then 'E_REQUIRED_IDS' end, case when nu > 20 then 'E_SUFFICIENT_IDS' end, case when nb > 0 then 'E_ROLE_OVERLAP' end,
        case when nr + nu = 0 and not insufficient then 'E_EVIDENCE_MISSING' end, case when nr + nu > 0 and insufficient then 'E_INSUFFICIENT_WITH_EVIDENCE' end], lambda x: x is not null)) as code from x""",
    "label_coverage": f"""with {sql.PATHS}, {OUTCOMES}, units as ({" union all ".join(f"select question_id, '{p}' as path_id, source_id as evidence_id from {sql._units(m)}" for p, m in structure.MODULES.items())}),
      l as (select question_id, path_id, evidence_id, 1 as l from labels where evidence_kind = 'ranked')
      select path_id, count(*) filter (u = 1 and l = 1) as labelled, count(*) filter (l is null) as unlabelled, count(*) filter (u is null) as unused_labels from (select *, 1 as u from units) full join l using (question_id, path_id, evidence_id) group by 1""",
    "blinded_payload": f"""with {_CODES}, {OUTCOMES.split(sql.QS + ",")[1]},
      m as (select question_id, evidence_kind, evidence_id, array_to_string(list_sort(list(distinct path_id)), '|') as occurrences, count(distinct path_id) as packages from labels group by all),
      r as (select 'EV-' || lpad(cast(row_number() over (order by sha256('20260723:' || question_code || chr(0) || evidence_kind || chr(0) || evidence_id), question_code, evidence_kind, evidence_id) as varchar), 7, '0') as row_code,
            question_code, evidence_kind, evidence_id, packages, occurrences from m join codes using (question_id))
      select row_code, question_code, evidence_kind, evidence_id, packages, sha256(row_code || chr(0) || question_code || chr(0) || evidence_kind || chr(0) || evidence_id) as identity_sha256, occurrences from r""",
    "candidate_structures": f"""with {sql.EDGES}, {sql._ITEMS},
      k as (select source_id, 'direct_clause' as category, 0 as ordinal, null as other from secs union all select seed_source_id, 'parent_heading_context', 1, source_id from items where context_type = 'immediate_parent'
            union all select seed_source_id, 'table_related', 2, source_id from items where context_type = 'table' union all select source_id, 'citation_dependency', 3, target_id from edges where confidence >= 0.85),
      c as (select distinct left(sha256(concat_ws(chr(0), domain, category, source_id, other)), 20) as candidate_id, domain, category, ordinal, document_id as source_group_id, source_id, concat_ws('|', source_id, other) as evidence_ids
            from k join secs using (source_id) where domain is not null),
      f as (select * from c qualify row_number() over (partition by category, source_group_id order by source_id, candidate_id) = 1)
      select *, cast(row_number() over (partition by category order by source_id, candidate_id) as int) as place from f qualify place <= 10""",
    "scope_candidates": f"""with {sql.SECS}, p as (select source_id, lower(regexp_replace(heading, '\\s+', '', 'g')) as h from secs)
      select source_id, array_to_string(list_filter([{", ".join(f"case when contains(h, '{t}') then '{t}' end" for t in sorted("".join(t.split()).lower() for t in TERMS))}], lambda x: x is not null), '|') as matched_terms
      from p where matched_terms <> ''""",
    "fingerprint": f"""with {sql.EDGES}, h as (
        select 'sections' as component, sha256(concat_ws(chr(1), source_id, coalesce(domain, chr(0)), coalesce(document_id, chr(0)), coalesce(heading, chr(0)), coalesce(content, chr(0)))) as h from secs
        union all select 'edges', sha256(concat_ws(chr(1), source_id, target_id, relation)) from edges),
      d as (select component, left(h, 6) as s, count(*) as n, sha256(array_to_string(list_sort(list(h)), '')) as leaf from h group by all),
      l as (select component, left(s, 3) as s, sum(n) as n, sha256(array_to_string(list(leaf order by s), '')) as leaf from d group by component, left(s, 3))
      select component, cast(sum(n) as bigint) as rows, sha256(array_to_string(list(leaf order by s), '')) as sha256 from l group by 1""",
    "rotation_chain": """with o as (select distinct batch_id, outer_test_fold, calibration_fold from fold_partitions),
      l as (select *, lag(calibration_fold) over (partition by batch_id order by outer_test_fold) as b from o)
      select batch_id, outer_test_fold from l where (case when outer_test_fold > 0 then outer_test_fold end) is distinct from b""",
    "privacy_scan": r"""with m as (select doc_id, text, regexp_extract_all(text, '(?im)^[ \t]*(?:export[ \t]+)?([A-Z0-9_]*(?:PASSWORD|API_KEY|SECRET|TOKEN)[A-Z0-9_]*)[ \t]*[:=][ \t]*["'']?([^\s#"''{}<>]+)', 1) as k,
        regexp_extract_all(text, '(?im)^[ \t]*(?:export[ \t]+)?([A-Z0-9_]*(?:PASSWORD|API_KEY|SECRET|TOKEN)[A-Z0-9_]*)[ \t]*[:=][ \t]*["'']?([^\s#"''{}<>]+)', 2) as v from documents)
      select cast(doc_id as varchar) as path, unnest(list_filter([
        case when regexp_matches(text, '(?i:\b[A-Z]:\\(?:Users|Projects)\\)|(?:^|[^A-Za-z0-9_])/(?:home|Users)/[^/\s]+/') then 'absolute-path' end,
        case when len(list_filter(list_zip(k, v), lambda p: not (lower(p[1]) like '%tokens' or p[1] like '\_%' escape '\' or lower(p[1]) like '%\_env' escape '\' or lower(p[1]) in ('false_token', 'maximum_input_tokens', 'tokenizer_revision', 'true_token')
             or regexp_matches(p[2], '^[A-Z][A-Z0-9_]*(?:PASSWORD|API_KEY|SECRET|TOKEN)[A-Z0-9_]*$') or p[2] like '$%' or lower(p[2]) in ('', 'changeme', 'change-me', 'example', 'none', 'null', 'placeholder', 'redacted')))) > 0 then 'possible-secret' end,
        case when strlen(text) > 1048576 then 'oversize-file' end], lambda x: x is not null)) as rule from m""",
}
