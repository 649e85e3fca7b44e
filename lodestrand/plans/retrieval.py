"""Retrieval and path queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text
from lodestrand.operators import retrieval, structure
from lodestrand.plans import sql
from lodestrand.session import materialize
from lodestrand.sources import tables


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sections(spark, sf_dir, "domain", "heading", "content").where("domain is not null").select("domain", "source_id", text.search_tokens(text.index_text("heading", "content")).alias("terms"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.questions(spark, sf_dir, "domain", "query_text").where("domain is not null").select("domain", "question_id", text.search_tokens("query_text").alias("terms"))


def tokenize_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search tokens of each section."""
    return _docs(spark, sf_dir).select("source_id", F.array_join("terms", " ").alias("tokens"), F.size("terms").alias("token_count"))


def bm25_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best sections of each question by BM25 within its domain."""
    return retrieval.bm25_top_blocked(_asked(spark, sf_dir), _docs(spark, sf_dir), "domain", "question_id", "source_id", "terms", 50)


def bm25_manual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual search: the hundred best sections for the cleaned phrase of each question, counted by question."""
    phrase = tables.questions(spark, sf_dir, "domain", "query_text").where("domain is not null").select("domain", "question_id", text.search_tokens(text.search_phrase("query_text")).alias("terms"))
    found = retrieval.bm25_top_blocked(phrase, _docs(spark, sf_dir), "domain", "question_id", "source_id", "terms", 100)
    return found.groupBy("question_id").agg(F.count(F.lit(1)).alias("found"), F.max("score").alias("best_score"))


def bm25_overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 fifty of each question reranked by term overlap, best ten."""
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    top = retrieval.bm25_top_blocked(asked, docs, "domain", "question_id", "source_id", "terms", 50)
    terms = asked.select("question_id", F.col("terms").alias("q")).join(top, "question_id").join(docs.select("source_id", F.col("terms").alias("d")), "source_id")
    stage = terms.select("question_id", "source_id", F.col("rank").alias("bm25_rank"), F.round(retrieval.overlap_score("q", "d"), 9).alias("reranker_score"))
    return retrieval.rerank(stage).select("question_id", "source_id", "rank", "reranker_score")


class Inputs:
    """What the paths share: the first stage, sections and edges; `kept` writes them once, for plans that use all six paths."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: bool = False):
        keep = materialize if kept else (lambda df: df)
        self.stage = keep(retrieval.first_stage(tables.candidates(spark, sf_dir)))
        self.sections = keep(tables.sections(spark, sf_dir, "document_id", "heading", "content", "source_type", "section_number"))
        self.edges = keep(structure.relation_edges(self.sections))
        self.bases = {0: keep(retrieval.direct(self.stage)), 1: keep(retrieval.rerank(self.stage))}
        self.items: dict[int, DataFrame] = {}
        self.keep = keep

    def context(self, reranked: int) -> DataFrame:
        """The context items of the seeds of either base."""
        if reranked not in self.items:
            seeds = self.bases[reranked].where(F.col("rank") <= structure.SEEDS)
            self.items[reranked] = self.keep(structure.context_items(seeds, self.sections, structure.SIDECARS + 1))
        return self.items[reranked]


def path_units(path: str, inputs: Inputs) -> DataFrame:
    """The ranked units of a path for all questions."""
    base = inputs.bases[structure.MODULES[path][0]]
    return structure.expand_one_hop(base, inputs.edges) if structure.MODULES[path][2] else structure.plain_units(base)


def path_sidecars(path: str, inputs: Inputs) -> DataFrame:
    """The sidecars of a path with context for all questions."""
    reranked = structure.MODULES[path][0]
    return structure.sidecars(inputs.bases[reranked], inputs.context(reranked))


def _path(path: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = Inputs(spark, sf_dir)
        units = path_units(path, inputs).select(
            "question_id", F.lit("unit").alias("part"), "rank", F.lit(0).alias("place"), "source_id", "origin", F.col("graph_seed_source_id").alias("seed")
        )
        if not structure.MODULES[path][1]:
            return units
        cars = path_sidecars(path, inputs).select(
            "question_id", F.lit("sidecar").alias("part"), F.col("seed_rank").alias("rank"), F.col("order_within_seed").alias("place"), "source_id", F.col("context_type").alias("origin"), F.col("seed_source_id").alias("seed")
        )
        return units.unionByName(cars)

    query.__doc__ = f"The units and sidecars of path {path} for every question."
    return query


def path_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six runs of every question."""
    inputs = Inputs(spark, sf_dir, kept=True)
    units = {p: path_units(p, inputs) for p in structure.MODULES}
    cars = {p: path_sidecars(p, inputs) for p, m in structure.MODULES.items() if m[1]}
    runs = structure.path_runs(units, cars)
    return runs.select("run_id", "question_id", "path_id", "status", F.array_join("ranked_source_ids", "|").alias("ranked"), F.array_join("sidecar_ids", "|").alias("sidecars"),
                       "neural_model_calls", "graph_targets_inserted", "context_items_attached")


def path_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of the six paths of every question."""
    inputs = Inputs(spark, sf_dir)
    runs = path_units("P0", inputs).select("question_id", F.explode(F.array(*[F.lit(p) for p in structure.MODULES])).alias("path_id"), F.lit("complete").alias("status")).distinct()
    return structure.complete_runs(tables.questions(spark, sf_dir, "domain"), runs)


def path_run_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken contracts of the six runs of every question."""
    inputs = Inputs(spark, sf_dir, kept=True)
    units = reduce(DataFrame.unionByName, [path_units(p, inputs).withColumn("path_id", F.lit(p)) for p in structure.MODULES])
    cars = reduce(DataFrame.unionByName, [path_sidecars(p, inputs).withColumn("path_id", F.lit(p)) for p, m in structure.MODULES.items() if m[1]])
    return structure.run_issues(units, cars)


def first_stage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose candidates, the best occurrence of each source, break the first stage's contract, as its SQL has it."""
    raw = tables.candidates(spark, sf_dir).where("rank is not null").select("question_id", "source_id", F.col("rank").alias("bm25_rank"))
    return retrieval.first_stage_issues(raw)


def path_run_delivered_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken contracts of the runs as delivered: every candidate_id once, sources that a question names twice included."""
    raw = tables.delivered_candidates(spark, sf_dir).where("rank between 1 and 10").select("question_id", F.lit("P0").alias("path_id"), "rank", "source_id", F.lit("direct").alias("origin"))
    none = raw.where("false").select("question_id", "path_id", F.col("source_id").alias("sidecar_id"))
    return structure.run_issues(raw, none)


def first_stage_delivered_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose candidates as delivered break the first stage's contract: depth, ranks, sources named twice, other domains."""
    raw = tables.delivered_candidates(spark, sf_dir).where("rank is not null").select("question_id", "source_id", "domain", F.col("rank").alias("bm25_rank"))
    crossed = retrieval.domain_issues(raw, tables.sections(spark, sf_dir, "domain"), tables.questions(spark, sf_dir, "domain"))
    return retrieval.first_stage_issues(raw).unionByName(crossed)


def edge_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation edges that sections state."""
    return structure.relation_edges(tables.sections(spark, sf_dir, "document_id", "content", "section_number"))


def graph_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known about the edges of each section before expansion."""
    sections = tables.sections(spark, sf_dir, "document_id", "content", "section_number")
    meta = structure.edge_metadata(sections, structure.relation_edges(sections))
    return meta.withColumn("relation_types", F.array_join("relation_types", "|"))


def context_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context items of every section."""
    sections = tables.sections(spark, sf_dir, "document_id", "heading", "source_type", "section_number")
    return structure.context_items(sections, sections)


QUERIES = {
    f.__name__: f
    for f in (tokenize_sections, bm25_top50, bm25_manual_search, bm25_overlap_rerank, path_runs, path_run_status, path_run_issues, first_stage_issues, path_run_delivered_issues, first_stage_delivered_issues, edge_normalize, graph_metadata, context_sidecars)
} | {f"path_{p.lower()}": _path(p) for p in structure.MODULES}

SQL = {
    "tokenize_sections": f"with {sql.DOCS} select source_id, array_to_string(terms, ' ') as tokens, cast(len(terms) as int) as token_count from docs",
    "bm25_top50": f"with {sql.BM25}, {sql.top('asked', 50)} select question_id, source_id, rank, score from top50",
    "bm25_manual_search": f"with {sql.BM25}, {sql.PHRASES}, {sql.top('phrases', 100)} select question_id, count(*) as found, max(score) as best_score from top100 group by 1",
    "bm25_overlap_rerank": f"""with {sql.BM25}, {sql.top('asked', 50)},
      scored as (select t.question_id, t.source_id, t.rank as bm25_rank, round(len(list_intersect(a.terms, d.terms)) / len(list_distinct(list_concat(a.terms, d.terms))), 9) as reranker_score
                 from top50 t join asked a using (question_id) join docs d using (source_id))
      select question_id, source_id, cast(row_number() over (partition by question_id order by reranker_score desc, bm25_rank, source_id) as int) as rank, reranker_score
      from scored qualify rank <= 10""",
    "path_run_status": f"""with {sql.QS}, {sql.CANDS}, s as (select distinct question_id, 1 as s from cands)
      select question_id, unnest(['P0', 'P1', 'P2', 'P3', 'P4', 'P5']) as path_id, case when s = 1 then 'complete' else 'execution_error' end as status, case when s is null then 'E_FIRST_STAGE' end as error_code
      from qs left join s using (question_id)""",
    "path_run_issues": f"""with {sql.PATHS},
      units as ({" union all ".join(f"select question_id, '{p}' as path_id, rank, source_id, origin from {sql._units(m)}" for p, m in structure.MODULES.items())}),
      cars as ({" union all ".join(f"select question_id, '{p}' as path_id, context_id from cars_p{m[0]}" for p, m in structure.MODULES.items() if m[1])}),
      sums as (select question_id, path_id, count(*) n, max(rank) top, count(distinct rank) ranks, count(source_id) named, count(distinct source_id) ids, count(*) filter (origin = 'graph') g from units group by all),
      side as (select question_id, path_id, count(*) m, count(distinct context_id) s from cars group by all)
      select question_id, path_id, unnest(list_filter([case when top <> n or ranks <> n then 'E_RANK_SEQUENCE' end, case when ids <> named then 'E_EVIDENCE_ID_DUPLICATE' end,
             case when m <> s then 'E_SIDECAR_ID_DUPLICATE' end, case when m > 0 and path_id in ({", ".join(f"'{p}'" for p, m in structure.MODULES.items() if not m[1])}) then 'E_PATH_CONTEXT_FORBIDDEN' end,
             case when g > 0 and path_id in ({", ".join(f"'{p}'" for p, m in structure.MODULES.items() if not m[2])}) then 'E_PATH_GRAPH_FORBIDDEN' end], lambda x: x is not null)) as code
      from sums left join side using (question_id, path_id)""",
    "first_stage_issues": f"""with {sql.CANDS},
      sums as (select question_id, count(*) n, max(rank) top, min(rank) low, count(distinct rank) ranks, count(distinct source_id) ids from cands where rank is not null group by 1)
      select question_id, unnest(list_filter([case when n > 50 then 'E_DEPTH' end, case when low <> 1 or top <> n or ranks <> n then 'E_RANK_SEQUENCE' end,
             case when ids <> n then 'E_EVIDENCE_ID_DUPLICATE' end], lambda x: x is not null)) as code from sums""",
    "edge_normalize": f"with {sql.EDGES} select source_id, target_id, relation, confidence from edges",
    "graph_metadata": f"""with {sql.EDGES}, m as (select source_id, count(distinct target_id) c, array_to_string(list_sort(list(distinct relation)), '|') r, max(confidence) x from edges where confidence >= 0.85 group by 1)
      select source_id, coalesce(c, 0) as eligible_count, coalesce(r, '') as relation_types, x as maximum_confidence from secs left join m using (source_id)""",
    "context_sidecars": f"with {sql.ITEMS} select seed_source_id, context_type, kind, context_id, source_id from items",
    **{f"path_{p.lower()}": sql.path(p, m) for p, m in structure.MODULES.items()},
    "path_runs": sql.runs(structure.MODULES),
}
