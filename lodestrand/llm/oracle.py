"""SQL that must agree with the queries."""

CELL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"

_AVAILABLE = f"""
cells as (
  select question_id, min((r, c)) as cell from (
    select question_id, {CELL.format('domain')} as r, {CELL.format('construction_category')} as c from queries
    where question_id is not null and domain is not null and construction_category is not null
  ) where (r, c) in (select ({CELL.format('domain')}, {CELL.format('construction_category')}) from sample_targets)
  group by question_id
),
counted as (
  select t.domain, t.construction_category, count(c.question_id) as available,
         greatest(any_value(t.target_rows), any_value(t.min_rows)) as wanted
  from sample_targets t
  left join cells c on c.cell = ({CELL.format('t.domain')}, {CELL.format('t.construction_category')})
  group by all
)"""

_FINITE = "case when isfinite({0}) then {0} end"
_TOP_TEN = f"""
with once as (
  select distinct question_id, candidate_id, {_FINITE.format('reranker_score')} as a, {_FINITE.format('score')} as b, rank, source_id
  from retrieval_candidates where question_id is not null and candidate_id is not null
)
select question_id, candidate_id, cast(row_number() over (
  partition by question_id order by a desc nulls last, b desc nulls last, rank asc nulls last, source_id asc nulls last, candidate_id
) as int) as position
from once qualify position <= 10"""

_VOTES = """
valid as (
  select question_id, path_id, evidence_id, annotated_at, annotation_id,
         trim(regexp_replace(lower(annotator_code), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') as a,
         upper(trim(regexp_replace(label, '[^\\p{L}\\p{N}]+', '_', 'g'), '_')) as x
  from evidence_annotations
  where trim(regexp_replace(lower(annotation_role), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') <> 'adjudicated'
    and question_id is not null and path_id is not null and evidence_id is not null and annotated_at is not null
),
votes as (
  select question_id, path_id, evidence_id, a, arg_max(x, (annotated_at, annotation_id)) as x from valid
  where x in ('REQUIRED', 'SUFFICIENT', 'CONTEXT', 'IRRELEVANT', 'HARMFUL') and length(a) > 0
  group by question_id, path_id, evidence_id, a
)"""
_AGREEMENT = f"""
with {_VOTES},
counts as (select question_id, path_id, evidence_id, x, count(*) as c from votes group by all),
items as (
  select question_id, path_id, evidence_id, sum(c) as m, sum(c * (c - 1)) as same from counts group by all having sum(c) > 1
),
labels as (select x, sum(c) as n from counts semi join items using (question_id, path_id, evidence_id) group by x),
sums as (
  select count(*) as items, cast(sum(m) as bigint) as ratings, sum((m * (m - 1) - same) / (m - 1)) / sum(m) as o,
         (select (sum(n) * sum(n) - sum(n * n)) / (sum(n) * (sum(n) - 1)) from labels) as e
  from items
)
select items, ratings, round(o, 9) as observed, round(e, 9) as expected, round(1 - o / e, 9) as alpha from sums"""

_GROUP = """lower(regexp_replace(source_group_id, '[^\\p{L}]+', '', 'g')) || '#'
  || regexp_replace(regexp_replace(source_group_id, '[^0-9]+', '', 'g'), '^0+([0-9])', '\\1')"""
_STRADDLING = f"""
with grouped as (select distinct question_id, {_GROUP} as g from queries where question_id is not null and source_group_id is not null),
tests as (select distinct batch_id, outer_test_fold as f, unnest(test_question_ids) as question_id from fold_partitions),
placed as (select * from tests join grouped using (question_id) where g <> '#')
select distinct question_id from placed
semi join (select batch_id, g from placed group by all having min(f) < max(f)) using (batch_id, g)"""

SQL = {
    "p4_agreement": _AGREEMENT,
    "p5_found": _STRADDLING,
    "p3_found": f"with {_AVAILABLE} select domain, construction_category from counted where available < wanted",
    "p6_found": f"select question_id, candidate_id from ({_TOP_TEN})",
    "p6_positions": _TOP_TEN,
}
