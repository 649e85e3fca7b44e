"""SQL of the evaluation queries."""

from __future__ import annotations

import unicodedata

from lodestrand.operators.outcomes import BUDGETS, CITATION_CUES, STAGES, TABLE_CUES
from lodestrand.plans.sql import CANDS, EDGES, QS, fold, slug
from lodestrand.sources.tables import LABELS, PATHS

_LABELS = ", ".join(f"'{x}'" for x in LABELS)
ANN = f"""
anno as (select annotation_id, any_value(question_id) as question_id, any_value(path_id) as path_id, any_value(evidence_id) as evidence_id, any_value(evidence_kind) as evidence_kind,
  upper({slug('any_value(label)')}) as label, {slug('any_value(annotation_role)')} as role, any_value(harmful_reason_code) as reason, any_value(annotated_at) as annotated_at, min(ingested_at) as ingested_at
  from evidence_annotations where annotation_id is not null group by annotation_id having upper({slug('any_value(label)')}) in ({_LABELS}))"""
OUTCOMES = f"""{QS}, {ANN},
labels as (select question_id, path_id, evidence_id, evidence_kind,
  arg_max(label, (case role when 'adjudicated' then 2 when 'primary' then 1 else 0 end, annotated_at, annotation_id)) as label from anno group by all),
seen as (select question_id, path_id, list(distinct regexp_extract(evidence_id, '^([^:]*)', 1)) as ids, bool_or(label = 'HARMFUL') as harmful_expansion, bool_or(label = 'SUFFICIENT') as sufficient_found,
  count(*) filter (evidence_kind = 'sidecar') as context_items_attached, count(*) as evidence_count from labels group by all),
specs as (select question_id, domain, category, list_distinct(coalesce(authoring_source_ids, [])) as required, coalesce(category = 'evidence_insufficient', false) as insufficient from qs),
outs as (select question_id, path_id, domain, category,
  case when insufficient then false when len(required) > 0 then len(list_intersect(ids, required)) = len(required) else sufficient_found end as evidence_complete, harmful_expansion,
  cast(len(list_intersect(ids, required)) as int) as required_found_count, cast(len(required) as int) as required_total_count, sufficient_found, context_items_attached, evidence_count
  from seen join specs using (question_id)),
outcomes as (select *, evidence_complete and not harmful_expansion as combined_path_success from outs)"""
_BUDGET = ", ".join(f"('{p}', {a}, {b}, {c})" for p, (a, b, c) in BUDGETS.items())
COSTS = f"""
budgets(path_id, neural_model_calls, graph_targets, context_items) as (values {_BUDGET}),
costs as (select b.*, m.median_runtime_ms from budgets b join (select path_id, cast(median(epoch(date_trunc('second', ingested_at)) - epoch(date_trunc('second', annotated_at))) as double) as median_runtime_ms
          from anno group by 1) m using (path_id))"""
_ORDER = "neural_model_calls, graph_targets, context_items, median_runtime_ms, path_id"
_RATES = """count(*) as question_path_count, count(*) filter (evidence_complete) as evidence_complete_count, count(*) filter (harmful_expansion) as harmful_expansion_count, count(*) filter (combined_path_success) as combined_path_success_count,
  round(avg(cast(evidence_complete as double)), 9) as evidence_complete_rate, round(avg(cast(harmful_expansion as double)), 9) as harmful_expansion_rate,
  round(avg(cast(combined_path_success as double)), 9) as combined_path_success_rate"""


def _wide(flag: str, name: str) -> str:
    cols = ", ".join(f"coalesce(bool_or({flag}) filter (path_id = '{p}'), false) as {p}" for p in PATHS)
    return f"{name} as (select question_id, {cols} from outcomes group by 1)"


WIDE = _wide("combined_path_success", "wide")
_STEPS = " union all ".join(f"select question_id, '{m}' as module, '{a}' as \"before\", '{b}' as \"after\", {a} as x, {b} as y from wide" for m, a, b in STAGES)
STEPS = f"{WIDE}, steps as ({_STEPS})"
FOLDS = """
folded as (select question_id, source_group_id, sha256('20260723:' || coalesce(source_group_id, '')) as assignment_hash from qs),
folds as (select *, cast(list_sum(list_transform(string_split(assignment_hash, ''), lambda d: strpos('123456789abcdef', d))) % 5 as int) as fold from folded)"""
PROBS = f"""{FOLDS},
rows_ as (select o.*, fold from outcomes o join folds using (question_id)),
by_fold as (select domain, category, path_id, fold, count(*) as n, count(*) filter (combined_path_success) as s from rows_ group by all),
total as (select domain, category, path_id, sum(n) as tn, sum(s) as ts from by_fold group by all),
rate as (select f.domain, f.category, f.path_id, fold, round((ts - s + 1) / (tn - n + 2), 9) as p from by_fold f join total t
         on f.domain is not distinct from t.domain and f.category is not distinct from t.category and f.path_id = t.path_id),
probs as (select r.question_id, r.path_id, p, r.combined_path_success as ok from rows_ r join rate t
          on r.domain is not distinct from t.domain and r.category is not distinct from t.category and r.path_id = t.path_id and r.fold = t.fold)"""
ROUTES = f"""
ranked as (select costs.path_id, row_number() over (order by {_ORDER}) as c from costs),
valued as (select question_id, probs.path_id, p, c from probs join ranked using (path_id)),
routes as (select question_id, arg_min(path_id, c) filter (p >= 0.5) as selected_path_id, arg_min(path_id, c) filter (p >= 0.5) is null as abstained,
           coalesce(arg_min(path_id, c) filter (p >= 0.5), arg_min(path_id, (-p, c))) as no_abstention_path_id from valued group by 1)"""
THRESHOLDS = """
ranked as (select costs.path_id, row_number() over (order by neural_model_calls, graph_targets, context_items, median_runtime_ms, costs.path_id) as c from costs),
valued as (select question_id, probs.path_id, p, ok, c from probs join ranked using (path_id)),
points as (select distinct p as threshold from valued),
picked as (select threshold, question_id, arg_min(ok, c) as ok from points join valued on p >= threshold group by all),
thresholds as (select threshold, count(*) as accepted, cast(sum(case when ok then 0 else 1 end) as bigint) as failures from picked group by 1)"""
PAIRS = f"""{ANN},
paired as (select question_id, path_id, evidence_id, evidence_kind,
  arg_max(label, (annotated_at, annotation_id)) filter (role = 'primary') as primary_label, arg_max(label, (annotated_at, annotation_id)) filter (role = 'duplicate') as duplicate_label,
  arg_max_null(reason, (annotated_at, annotation_id)) filter (role = 'primary') as primary_reason, arg_max_null(reason, (annotated_at, annotation_id)) filter (role = 'duplicate') as duplicate_reason,
  arg_max(annotation_id, (annotated_at, annotation_id)) filter (role = 'primary') as primary_annotation_id, arg_max(annotation_id, (annotated_at, annotation_id)) filter (role = 'duplicate') as duplicate_annotation_id
  from anno where role in ('primary', 'duplicate') group by all),
pairs as (select * from paired where primary_label is not null and duplicate_label is not null)"""
_STAGE = "stage as (select question_id, source_id, score, cast(row_number() over (partition by question_id order by rank nulls last, score desc nulls last, source_id) as int) as bm25_rank from cands qualify bm25_rank <= 50)"
SCORES = f"""{CANDS}, {_STAGE},
scores as (select question_id, list_reverse_sort(list(score)) as s from stage where bm25_rank <= 10 and score is not null group by 1)"""
# Characters whose compatibility form differs, with that form: made from the Unicode data, as DuckDB has no such function.
_FORMS = ", ".join(f"({i}, '{f}')" for i, f in ((i, unicodedata.normalize("NFKC", chr(i)).replace("'", "''")) for i in range(128, 0x1F000) if not 0xAC00 <= i < 0xE000) if f != chr(i))
PLAIN = f"""forms(c, f) as (values {_FORMS}),
spelled as (select question_id, nfc_normalize(string_agg(coalesce(f, chr(cast(k as int))), '' order by i)) as t
  from (select question_id, unicode(x) as k, i from (select question_id, unnest(string_split(query_text, '')) as x, generate_subscripts(string_split(query_text, ''), 1) as i from qs where query_text <> ''))
  left join forms on c = k group by question_id),
plain as (select question_id, {fold("trim(regexp_replace(t, '\\s+', ' ', 'g'), ' ')")} as n from spelled)"""
_NORMAL = "n"


def _has(cues: list[str]) -> str:
    return "coalesce(" + " or ".join(f"contains({_NORMAL}, '{c}')" for c in cues) + ", false)"


def _gap(k: int) -> str:
    return f"coalesce((s[1] - s[{k + 1}]) / greatest(abs(s[1]), 1e-9), 0.0)"


FEATURES = f"""{PLAIN},
shared as (select q.question_id, q.domain, cast(coalesce(length({_NORMAL}), 0) as int) as query_length, round(s[1], 6) as bm25_top_score, round({_gap(1)}, 6) as bm25_gap_1_2, round({_gap(4)}, 6) as bm25_gap_1_5,
  {_gap(1)} as g, {_has(TABLE_CUES)} as t, {_has(CITATION_CUES)} as c, s from qs q join scores using (question_id) left join plain using (question_id) where len(s) > 1)"""
_MCNEMAR = """case when n = 0 or 2 * k = n then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))) end"""

SQL = {
    "path_outcomes": f"with {OUTCOMES} select * from outcomes",
    "outcome_summary": f"""with {OUTCOMES} select coalesce(case when grouping(domain) = 1 then 'all' end, domain) as domain, path_id, {_RATES}, round(avg(context_items_attached), 9) as mean_context_items_attached
      from outcomes group by grouping sets ((path_id), (domain, path_id))""",
    "stratum_summary": f"with {OUTCOMES} select domain, category, path_id, {_RATES} from outcomes group by all",
    "stage_rescues": f"""with {OUTCOMES}, {STEPS} select domain, category, module, "before", "after", count(*) as questions, count(*) filter (not x and y) as rescued, count(*) filter (x and not y) as lost
      from steps join (select distinct question_id, domain, category from outcomes) using (question_id) group by all""",
    "path_costs": f"with {ANN}, {COSTS} select * from costs",
    "oracle_policy": f"""with {OUTCOMES}, {COSTS}, ranked as (select path_id, row_number() over (order by {_ORDER}) as c from costs)
      select question_id, arg_min(path_id, c) filter (combined_path_success) as selected_path_id, not bool_or(combined_path_success) as abstained, bool_or(combined_path_success) as routable
      from outcomes join ranked using (path_id) group by 1""",
    "constant_policies": f"with {QS} select question_id, 'bm25' as policy_id, 'P0' as selected_path_id from qs union all select question_id, 'all_modules', 'P5' from qs",
    "heuristic_policy": f"""with {QS}, {SCORES}, {FEATURES}
      select question_id, case when t and c then 'P5' when c then 'P3' when t then 'P2' when g < 0.15 then 'P1' else 'P0' end as selected_path_id from shared""",
    "route_features": f"""with {QS}, {SCORES}, {FEATURES}, {EDGES}, {ANN}, {COSTS},
      meta as (select question_id, count(distinct (source_id, target_id)) as e, max(confidence) as x from stage join edges using (source_id) where bm25_rank <= 5 and confidence >= 0.85 group by 1)
      select shared.question_id, domain, query_length, bm25_top_score, bm25_gap_1_2, bm25_gap_1_5,
        round(-list_sum(list_transform(s, lambda v: exp(v - s[1]) / list_sum(list_transform(s, lambda w: exp(w - s[1]))) * (v - s[1] - ln(list_sum(list_transform(s, lambda w: exp(w - s[1]))))))), 6) as bm25_top10_entropy,
        cast(t as int) as has_table_context_cue, cast(c as int) as has_citation_dependency_cue, coalesce(e, 0) as eligible_outgoing_edge_count, coalesce(x, 0.0) as max_edge_confidence, path_id,
        neural_model_calls as cost_neural_calls, graph_targets as cost_graph_targets, context_items as cost_context_items, median_runtime_ms as cost_median_runtime_ms
      from shared left join meta using (question_id) cross join costs""",
    "threshold_table": f"with {OUTCOMES}, {COSTS}, {PROBS}, {THRESHOLDS} select * from thresholds",
    "threshold_search": f"""with {OUTCOMES}, {COSTS}, {PROBS}, {THRESHOLDS}, bounds(b) as (values (0.1::double), (0.6::double)),
      best as (select b, min(threshold) as threshold from bounds join thresholds on accepted >= 10 and failures <= b * accepted + 1e-12 group by 1)
      select threshold, threshold is null as force_abstain, coalesce(accepted, 0) as accepted_count, round(failures / accepted, 9) as failure_rate, b as failure_bound
      from bounds left join best using (b) left join thresholds using (threshold)""",
    "selective_route": f"with {OUTCOMES}, {COSTS}, {PROBS}, {ROUTES} select * from routes",
    "selective_metrics": f"""with {OUTCOMES}, {COSTS}, {PROBS}, {ROUTES},
      k as (select not abstained as kept, coalesce(combined_path_success, false) as won from routes left join outcomes on routes.question_id = outcomes.question_id and selected_path_id = path_id)
      select count(*) as question_count, count(*) filter (kept) as accepted_count, round(count(*) filter (kept) / count(*), 9) as coverage, round(1 - count(*) filter (kept) / count(*), 9) as abstention_rate,
        round(1 - count(*) filter (kept and won) / nullif(count(*) filter (kept), 0), 9) as accepted_failure_rate from k""",
    "brier_ece": f"""with {OUTCOMES}, {PROBS},
      bins as (select len(list_filter([{", ".join(f"{k}/10.0::double" for k in range(1, 10))}], lambda e: e <= p)) as b, count(*) as n, avg(p) as c, avg(cast(ok as double)) as a from probs group by 1)
      select round((select avg(power(p - cast(ok as double), 2)) from probs), 9) as brier, round(sum(n * abs(a - c)) / sum(n), 9) as ece, cast(sum(n) as bigint) as rows from bins""",
    "kappa": f"""with {PAIRS}, m as (select count(*) as n, count(*) filter (primary_label = duplicate_label) as same from pairs),
      l as (select label, count(*) filter (k = 1) as a, count(*) filter (k = 2) as b from (select primary_label as label, 1 as k from pairs union all select duplicate_label, 2 from pairs) group by 1),
      e as (select sum(a * b) as chance, count(*) as used from l)
      select n as pairs, round(same / n, 9) as exact_agreement, round(case when used > 1 then (same / n - chance / (n * n)) / (1 - chance / (n * n)) end, 9) as kappa from m, e""",
    "confusion_matrix": f"with {PAIRS} select primary_label, " + ", ".join(f"count(*) filter (duplicate_label = '{x}') as {x}" for x in LABELS) + " from pairs group by 1",
    "specific_agreement": f"""with {PAIRS}, names(label) as (values {", ".join(f"('{x}')" for x in LABELS)})
      select label, round(2.0::double * (select count(*) from pairs where primary_label = label and duplicate_label = label) /
        nullif((select count(*) from pairs where primary_label = label) + (select count(*) from pairs where duplicate_label = label), 0), 9) as specific_agreement from names""",
    "adjudication_queue": f"""with {PAIRS} select 'ADJQ-' || left(sha256(question_id || chr(0) || evidence_kind || chr(0) || path_id || '/' || evidence_id), 16) as queue_id, *,
        case when primary_label <> duplicate_label then 'label_disagreement' else 'harmful_reason_disagreement' end as queue_reason
      from pairs where primary_label <> duplicate_label or (primary_label = 'HARMFUL' and duplicate_label = 'HARMFUL' and primary_reason is distinct from duplicate_reason)""",
    "mcnemar_stage": f"""with {OUTCOMES}, {STEPS},
      t as (select module, "before", "after", cast(count(*) filter (not x and y) as bigint) as rescued, cast(count(*) filter (x and not y) as bigint) as lost from steps group by all),
      c as (select *, rescued + lost as n, least(rescued, lost) as k from t),
      p as (select module, "before", "after", rescued, lost, round({_MCNEMAR}, 12) as p_value from c),
      r as (select *, row_number() over (order by p_value, module, "before") as r, count(*) over () as m from p)
      select module, "before", "after", rescued, lost, p_value, round(least(1.0, max((m - r + 1) * p_value) over (order by r)), 12) as p_holm from r""",
    "signals_1_2_3": f"""with {OUTCOMES}, {COSTS}, {WIDE}, {_wide("harmful_expansion", "harm")}, {_wide("evidence_complete", "done")}, ranked as (select path_id, neural_model_calls, row_number() over (order by {_ORDER}) as c from costs),
      s as (select count(*) as questions, count(*) filter (not P0 and (P1 or P2 or P3 or P4 or P5)) as rescued, count(*) filter (P0) as p0, count(*) filter (not P0 and P1) as a, count(*) filter ((not P0 and P2) or (not P1 and P4)) as b,
            count(*) filter ((not P0 and P3) or (not P4 and P5)) as g from wide),
      pick as (select question_id, arg_min(path_id, c) as path_id from outcomes join ranked using (path_id) where combined_path_success group by 1),
      o as (select count(*) as routable, avg(neural_model_calls) as calls, avg(cast(wide.P5 as int)) as s5, avg(cast(x.harmful_expansion as int)) as oh, avg(cast(harm.P5 as int)) as h5, avg(cast(x.evidence_complete as int)) as oc,
            avg(cast(done.P5 as int)) as c5 from pick join outcomes x using (question_id, path_id) join ranked using (path_id) join wide using (question_id) join harm using (question_id) join done using (question_id))
      select questions, rescued, round(rescued / questions, 9) as rescued_fraction, rescued / questions >= 0.2 as signal_1, a as rescued_by_reranking, b as rescued_by_context, g as rescued_by_graph,
        cast(a >= 5 as int) + cast(b >= 5 as int) + cast(g >= 5 as int) >= 2 as signal_2, routable, round(calls, 9) as oracle_mean_neural_calls, round(h5, 9) as p5_harm_rate, round(oh, 9) as oracle_harm_rate,
        coalesce(routable / questions - p0 / questions >= 0.05 or (1.0 - s5 >= -0.02 and 1.0 - calls >= 0.2) or (h5 - oh >= 0.05 and oc - c5 >= -0.02), false) as signal_3 from s, o""",
    "fold_assignment": f"with {QS}, {FOLDS} select question_id, source_group_id, fold, assignment_hash from folds",
    "fold_rotations": f"""with {QS}, {FOLDS}, r as (select *, unnest(range(5)) as i from folds)
      select cast(i as int) as outer_test_fold, case when fold = i then 'test' when fold = (i + 1) % 5 then 'calibration' else 'train' end as part, count(*) as questions, count(distinct source_group_id) as groups from r group by all""",
    "partition_issues": """select distinct batch_id, outer_test_fold, unnest(list_filter([
        case when len(train_question_ids) < 1 or len(calibration_question_ids) < 1 or len(test_question_ids) < 1 then 'E_PART_EMPTY' end,
        case when list_has_any(train_question_ids, calibration_question_ids) or list_has_any(train_question_ids, test_question_ids) or list_has_any(calibration_question_ids, test_question_ids) then 'E_PARTS_OVERLAP' end,
        case when calibration_fold <> (outer_test_fold + 1) % 5 then 'E_ROTATION' end,
        case when len(list_distinct(train_question_ids)) < len(train_question_ids) or len(list_distinct(calibration_question_ids)) < len(calibration_question_ids) or len(list_distinct(test_question_ids)) < len(test_question_ids)
             then 'E_ID_REPEATED' end], lambda x: x is not null)) as code from fold_partitions""",
    "stratified_sample": f"""with {QS} select domain, category, question_id, cast(row_number() over (partition by domain, category order by sha256('20260723' || chr(0) || domain || chr(0) || category || chr(0) || question_id), question_id) as int) as place
      from qs where domain is not null and category is not null qualify place <= 3""",
}
