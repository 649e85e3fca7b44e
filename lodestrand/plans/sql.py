"""Shared parts of the SQL: the cleaned tables and the stages of retrieval as common table expressions."""

from __future__ import annotations

from lodestrand.functions.text import FOLDINGS


def slug(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"


def fold(c: str) -> str:
    out = f"lower({c})"
    for a, b in FOLDINGS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def tokens(c: str) -> str:
    """Latin tokens, then pairs of ideographs."""
    text = f"coalesce({c}, '')"
    runs = f"regexp_extract_all({text}, '[\\x{{4e00}}-\\x{{9fff}}]+')"
    pairs = f"flatten(list_transform({runs}, lambda r: case when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substring(r, cast(i as bigint), 2)) end))"
    return f"list_concat(regexp_extract_all({fold(text)}, '[a-z0-9]+'), {pairs})"


QS = f"""
qs as (select question_id, {slug('any_value(domain)')} as domain, {slug('any_value(construction_category)')} as category, any_value(query_text) as query_text,
       any_value(source_group_id) as source_group_id, any_value(authoring_source_ids) as authoring_source_ids, lower(trim(any_value(language))) as language
       from queries where question_id is not null group by question_id)"""
SECS = f"""
secs as (select source_id, {slug('any_value(domain)')} as domain, any_value(document_id) as document_id, any_value(heading) as heading, any_value(content) as content,
         any_value(source_type) as source_type, nullif(regexp_extract(any_value(heading), '^\\s*([0-9]+(?:\\.[0-9]+)*)', 1), '') as section_number
         from source_sections where source_id is not null group by source_id)"""
DOCS = f"""{SECS},
docs as (select domain, source_id, {tokens("left(concat_ws(chr(10), nullif(trim(heading, ' '), ''), nullif(trim(content, ' '), '')), 2000)")} as terms from secs where domain is not null)"""
BM25 = f"""{QS}, {DOCS},
asked as (select domain, question_id, {tokens('query_text')} as terms from qs where domain is not null),
tf as (select domain, source_id, len_, term, count(*) as tf from (select domain, source_id, len(terms) as len_, unnest(terms) as term from docs) group by all),
df as (select domain, term, count(*) as df from tf group by all),
totals as (select domain, count(*) as n, avg(len(terms)) as a from docs group by domain),
posts as (select domain, source_id, term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25 + 0.75 * len_ / a)) as weight
          from tf join df using (domain, term) join totals using (domain))"""
PHRASES = f"""
phrases as (select domain, question_id, {tokens("nullif(trim(regexp_replace(regexp_replace(query_text, '[+\\-&|!(){}\\[\\]^\"~*?:\\\\/]', ' ', 'g'), '\\s+', ' ', 'g')), '')")} as terms from qs where domain is not null)"""


def top(asked: str, k: int) -> str:
    return f"""
top{k} as (
  select question_id, source_id, cast(row_number() over (partition by question_id order by score desc, source_id) as int) as rank, score
  from (select question_id, source_id, round(sum(qtf * weight), 6) as score
        from (select domain, question_id, term, count(*) as qtf from (select domain, question_id, unnest(terms) as term from {asked}) group by all)
        join posts using (domain, term) group by all)
  where score > 0 qualify rank <= {k})"""


FINITE = "case when isfinite({0}) then {0} end"
CANDS = f"""
cands as (
  select question_id, source_id, rank, {FINITE.format('score')} as score, {FINITE.format('reranker_score')} as reranker_score, candidate_id
  from retrieval_candidates where question_id is not null and source_id is not null
  qualify row_number() over (partition by question_id, source_id order by rank is null, rank, candidate_id) = 1)"""
NUMBERED = "numbered as (select document_id, section_number, count(*) as n, min(source_id) as holder from secs where document_id is not null and section_number is not null group by all)"
PARENT = "nullif(regexp_replace({0}, '\\.?[0-9]+$', ''), '')"
EDGES = f"""{SECS}, {NUMBERED},
uniq as (select document_id, section_number as number, holder from numbered where n = 1),
refs as (select source_id, document_id, unnest(list_distinct(list_concat(regexp_extract_all(coalesce(content, ''), '第([0-9]+(?:\\.[0-9]+)*)条', 1),
         regexp_extract_all(coalesce(content, ''), 'clause ([0-9]+(?:\\.[0-9]+)*)', 1)))) as number from secs where document_id is not null),
edges as (
  select source_id, target_id, relation, max(confidence) as confidence from (
    select source_id, holder as target_id, 'CITES' as relation, 0.95::double as confidence from refs join uniq using (document_id, number)
    union all
    select source_id, holder, 'CITES', 0.80::double from (select source_id, document_id, {PARENT.format('number')} as number from refs) join uniq using (document_id, number)
    union all
    select source_id, holder, 'DEPENDS_ON', 0.90::double from (select source_id, document_id, {PARENT.format('section_number')} as number from secs) join uniq using (document_id, number)
  ) where source_id <> target_id group by all)"""
_ITEMS = f"""
notes as (select document_id, source_id as note from secs where source_type = 'table_note' and document_id is not null
          qualify row_number() over (partition by document_id order by source_id) <= 4),
items as (
  select source_id as seed_source_id, 'heading_path' as context_type, 0 as kind, source_id || ':heading' as context_id, source_id from secs where trim(heading, ' ') <> ''
  union all
  select s.source_id, 'immediate_parent', 1, s.source_id || ':parent', holder from (select source_id, document_id, {PARENT.format('section_number')} as section_number from secs) s
  join numbered using (document_id, section_number) where holder <> s.source_id
  union all
  select s.source_id, 'table', 2, s.source_id || ':table:' || note, note from secs s join notes using (document_id) where note <> s.source_id)"""
_FIRST_NOTES = """
          qualify row_number() over (partition by document_id order by source_id) <= 4"""
ITEMS = f"{SECS}, {NUMBERED}, {_ITEMS.replace(_FIRST_NOTES, '')}"
PATHS = f"""{CANDS}, {EDGES}, {_ITEMS},
stage as (select question_id, source_id, reranker_score, cast(row_number() over (partition by question_id order by rank nulls last, score desc nulls last, source_id) as int) as bm25_rank
          from cands qualify bm25_rank <= 50),
base_p0 as (select question_id, source_id, bm25_rank, bm25_rank as rank from stage where bm25_rank <= 10),
base_p1 as (select question_id, source_id, bm25_rank, cast(row_number() over (partition by question_id order by reranker_score desc nulls last, bm25_rank, source_id) as int) as rank
            from stage qualify rank <= 10),
best as (select *, cast(row_number() over (partition by seed_source_id order by kind, source_id, context_id) as int) as place from items qualify place <= 3)"""


def _derived(base: str) -> str:
    return f"""
cars_{base} as (select b.question_id, b.rank as seed_rank, place, seed_source_id, context_type, context_id, i.source_id
                from base_{base} b join best i on i.seed_source_id = b.source_id where b.rank <= 5),
found_{base} as (select b.question_id, b.rank as seed_rank, b.source_id as seed, target_id, relation, confidence from base_{base} b join edges e using (source_id)
                 where b.rank <= 5 and confidence >= 0.85 and not exists (select 1 from base_{base} x where x.question_id = b.question_id and x.source_id = target_id)),
once_{base} as (select * from found_{base} qualify row_number() over (partition by question_id, target_id order by seed_rank, confidence desc, relation) = 1),
chosen_{base} as (select *, row_number() over (partition by question_id order by seed_rank, confidence desc, relation, target_id) as o from once_{base} qualify o <= 5),
hop_{base} as (
  select question_id, source_id, origin, seed, cast(row_number() over (partition by question_id order by part, o) as int) as rank from (
    select question_id, source_id, 'direct' as origin, null as seed, case when rank <= 5 then 0 else 2 end as part, rank as o from base_{base}
    union all select question_id, target_id, 'graph', seed, 1, o from chosen_{base}) qualify rank <= 10)"""


PATHS += "," + _derived("p0") + "," + _derived("p1")


def _units(modules: tuple[int, int, int]) -> str:
    base = f"p{modules[0]}"
    return f"hop_{base}" if modules[2] else f"(select question_id, source_id, 'direct' as origin, cast(null as varchar) as seed, rank from base_{base})"


def path(name: str, modules: tuple[int, int, int]) -> str:
    cars = f" union all select question_id, 'sidecar', seed_rank, place, source_id, context_type, seed_source_id from cars_p{modules[0]}" if modules[1] else ""
    return f"with {PATHS} select question_id, 'unit' as part, rank, 0 as place, source_id, origin, seed from {_units(modules)}{cars}"


def runs(paths: dict[str, tuple[int, int, int]]) -> str:
    each = []
    for p, m in paths.items():
        side = f"(select question_id, array_to_string(list(context_id order by seed_rank, place), '|') as s, count(*) as c from cars_p{m[0]} group by 1)" if m[1] else "(select null as question_id, null as s, null as c where false)"
        each.append(f"""select 'RUN-' || u.question_id || '-{p}' as run_id, u.question_id, '{p}' as path_id, 'complete' as status, u.r as ranked, coalesce(s, '') as sidecars,
          {m[0]} as neural_model_calls, cast(g as int) as graph_targets_inserted, cast(coalesce(c, 0) as int) as context_items_attached
          from (select question_id, array_to_string(list(source_id order by rank), '|') as r, count(*) filter (origin = 'graph') as g from {_units(m)} group by 1) u
          left join {side} x on x.question_id = u.question_id""")
    return f"with {PATHS} " + " union all ".join(each)
