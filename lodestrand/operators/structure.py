"""Structure around sections: context sidecars, relation edges, one-hop expansion, and the six retrieval paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEDS, SIDECARS, TARGETS, CUTOFF, CONFIDENCE = 5, 3, 5, 10, 0.85
#: Modules of each path: reranking, context, graph.
MODULES = {"P0": (0, 0, 0), "P1": (1, 0, 0), "P2": (0, 1, 0), "P3": (0, 0, 1), "P4": (1, 1, 0), "P5": (1, 1, 1)}


def parent_number(number: str | Column) -> Column:
    """A section number without its last part, null for a number of one part."""
    return F.nullif(F.regexp_replace(number, r"\.?[0-9]+$", ""), F.lit(""))


def numbered(sections: DataFrame) -> DataFrame:
    """(document_id, section_number, count, first source_id): one row a number of a document, whatever the document's size."""
    there = sections.where("document_id is not null and section_number is not null")
    return there.groupBy("document_id", "section_number").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("holder"))


def relation_edges(sections: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, confidence): what sections say about others of their document.

    A cited clause number resolves to the section that alone has it (CITES, 0.95), else to the one that alone has its
    parent number (CITES, 0.80); a section depends on the one that alone has its parent number (DEPENDS_ON, 0.90). Numbers
    that several sections have resolve to none. Loops are dropped; of repeated edges the most confident stays.
    """
    unique = numbered(sections).where("n = 1").select("document_id", F.col("section_number").alias("number"), "holder")
    cited = F.concat(
        F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("第([0-9]+(?:\\.[0-9]+)*)条"), F.lit(1)),
        F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"clause ([0-9]+(?:\.[0-9]+)*)"), F.lit(1)),
    )
    refs = sections.where("document_id is not null").select("source_id", "document_id", F.explode(F.array_distinct(cited)).alias("number"))
    exact = refs.join(unique, ["document_id", "number"]).select("source_id", F.col("holder").alias("target_id"), F.lit("CITES").alias("relation"), F.lit(0.95).alias("confidence"))
    wider = refs.withColumn("number", parent_number("number")).where("number is not null")
    loose = wider.join(unique, ["document_id", "number"]).select("source_id", F.col("holder").alias("target_id"), F.lit("CITES").alias("relation"), F.lit(0.80).alias("confidence"))
    parents = sections.where("document_id is not null").select("source_id", "document_id", parent_number("section_number").alias("number")).where("number is not null")
    depends = parents.join(unique, ["document_id", "number"]).select("source_id", F.col("holder").alias("target_id"), F.lit("DEPENDS_ON").alias("relation"), F.lit(0.90).alias("confidence"))
    edges = exact.unionByName(loose).unionByName(depends).where("source_id <> target_id")
    return edges.groupBy("source_id", "target_id", "relation").agg(F.max("confidence").alias("confidence"))


def edge_metadata(seeds: DataFrame, edges: DataFrame, minimum: float = CONFIDENCE) -> DataFrame:
    """(source_id, eligible_count, relation_types, maximum_confidence) of each seed, zero and empty where it has no edge."""
    eligible = edges.where(F.col("confidence") >= minimum)
    sums = eligible.groupBy("source_id").agg(
        F.count_distinct("target_id").alias("eligible_count"), F.array_sort(F.collect_set("relation")).alias("relation_types"), F.max("confidence").alias("maximum_confidence")
    )
    return seeds.select("source_id").distinct().join(sums, "source_id", "left").select(
        "source_id", F.coalesce("eligible_count", F.lit(0)).alias("eligible_count"), F.coalesce("relation_types", F.array().cast("array<string>")).alias("relation_types"), "maximum_confidence"
    )


def context_items(seeds: DataFrame, sections: DataFrame, most_notes: int | None = None) -> DataFrame:
    """(seed_source_id, context_type, kind, context_id, source_id): heading, parent and tables around each seed section.

    The parent is the first section of the document with the parent number; tables are the table notes of the document (the seed
    itself apart). most_notes: only so many first notes of a document, for callers that attach fewer than that to a seed anyway.
    """
    here = sections.join(seeds.select("source_id").distinct(), "source_id", "left_semi")
    headings = here.where("trim(heading) <> ''").select(
        F.col("source_id").alias("seed_source_id"), F.lit("heading_path").alias("context_type"), F.lit(0).alias("kind"), F.concat("source_id", F.lit(":heading")).alias("context_id"), "source_id"
    )
    holders = numbered(sections).select("document_id", F.col("section_number").alias("number"), "holder")
    parents = here.select("source_id", "document_id", parent_number("section_number").alias("number")).join(holders, ["document_id", "number"]).where("holder <> source_id").select(
        F.col("source_id").alias("seed_source_id"), F.lit("immediate_parent").alias("context_type"), F.lit(1).alias("kind"), F.concat("source_id", F.lit(":parent")).alias("context_id"), F.col("holder").alias("source_id")
    )
    notes = sections.where("source_type = 'table_note' and document_id is not null").select("document_id", F.col("source_id").alias("note"))
    if most_notes is not None:
        place = F.row_number().over(Window.partitionBy("document_id").orderBy("note"))
        notes = notes.withColumn("place", place).where(F.col("place") <= most_notes).drop("place")
    tables = here.select("source_id", "document_id").join(notes, "document_id").where("note <> source_id").select(
        F.col("source_id").alias("seed_source_id"), F.lit("table").alias("context_type"), F.lit(2).alias("kind"), F.concat("source_id", F.lit(":table:"), "note").alias("context_id"), F.col("note").alias("source_id")
    )
    return headings.unionByName(parents).unionByName(tables)


def sidecars(units: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, seed_rank, order_within_seed, seed_source_id, context_type, sidecar_id, source_id): at most three for each of five seeds.

    Identifiers hold their seed's, so an item is never attached to two seeds of a question.
    """
    seeds = units.where(F.col("rank") <= SEEDS).select("question_id", F.col("rank").alias("seed_rank"), F.col("source_id").alias("seed_source_id"))
    order = F.row_number().over(Window.partitionBy("seed_source_id").orderBy("kind", "source_id", "context_id"))
    best = items.withColumn("order_within_seed", order).where(F.col("order_within_seed") <= SIDECARS)
    return seeds.join(best, "seed_source_id").select(
        "question_id", "seed_rank", "order_within_seed", "seed_source_id", "context_type", F.col("context_id").alias("sidecar_id"), "source_id"
    )


def expand_one_hop(units: DataFrame, edges: DataFrame, minimum: float = CONFIDENCE) -> DataFrame:
    """Five seeds, then up to five new targets of their edges, then the remaining direct units, ten in all.

    Targets in order of seed, confidence, relation and id, each once, none that is among the direct units. A target carries
    its seed's bm25_rank and no reranker score.
    """
    seeds = units.where(F.col("rank") <= SEEDS)
    found = (
        seeds.select("question_id", F.col("rank").alias("seed_rank"), F.col("source_id").alias("graph_seed_source_id"), "bm25_rank")
        .join(edges.where(F.col("confidence") >= minimum).withColumnRenamed("source_id", "graph_seed_source_id"), "graph_seed_source_id")
        .join(units.select("question_id", F.col("source_id").alias("target_id")), ["question_id", "target_id"], "left_anti")
    )
    order = [F.asc("seed_rank"), F.desc("confidence"), F.asc("relation"), F.asc("target_id")]
    once = found.withColumn("_o", F.row_number().over(Window.partitionBy("question_id", "target_id").orderBy(*order))).where("_o = 1")
    chosen = once.withColumn("_o", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("_o") <= TARGETS)
    null = F.lit(None).cast("string")
    kept = units.select(
        "question_id", F.when(F.col("rank") <= SEEDS, 0).otherwise(2).alias("_part"), F.col("rank").alias("_o"), "source_id", F.lit("direct").alias("origin"), "bm25_rank", "reranker_score",
        null.alias("graph_seed_source_id"), null.alias("relation"), F.lit(None).cast("double").alias("confidence"),
    )
    added = chosen.select(
        "question_id", F.lit(1).alias("_part"), "_o", F.col("target_id").alias("source_id"), F.lit("graph").alias("origin"), "bm25_rank", F.lit(None).cast("double").alias("reranker_score"),
        "graph_seed_source_id", "relation", "confidence",
    )
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("_part", "_o"))
    return kept.unionByName(added).withColumn("rank", rank).where(F.col("rank") <= CUTOFF).drop("_part", "_o")


def plain_units(units: DataFrame) -> DataFrame:
    """Direct units in the columns of expanded ones."""
    null = F.lit(None).cast("string")
    return units.select(
        "question_id", "source_id", F.lit("direct").alias("origin"), "bm25_rank", "reranker_score", null.alias("graph_seed_source_id"), null.alias("relation"),
        F.lit(None).cast("double").alias("confidence"), "rank",
    )


def path_runs(units: dict[str, DataFrame], attached: dict[str, DataFrame]) -> DataFrame:
    """One row a question and path: run_id, ranked sources and sidecars in order, and the counts of what was used."""
    ranked = reduce(DataFrame.unionByName, [u.withColumn("path_id", F.lit(p)) for p, u in units.items()])
    lists = ranked.groupBy("question_id", "path_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id"))), lambda r: r["source_id"]).alias("ranked_source_ids"),
        F.count_if(F.col("origin") == "graph").cast("int").alias("graph_targets_inserted"),
    )
    side = reduce(DataFrame.unionByName, [s.withColumn("path_id", F.lit(p)) for p, s in attached.items()])
    cars = side.groupBy("question_id", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed_rank", "order_within_seed", "sidecar_id"))), lambda r: r["sidecar_id"]).alias("sidecar_ids"))
    empty = F.array().cast("array<string>")
    neural = F.element_at(F.create_map(*[F.lit(x) for p, m in MODULES.items() for x in (p, m[0])]), F.col("path_id"))
    return lists.join(cars, ["question_id", "path_id"], "left").select(
        F.concat(F.lit("RUN-"), "question_id", F.lit("-"), "path_id").alias("run_id"), "question_id", "path_id", F.lit("complete").alias("status"), "ranked_source_ids",
        F.coalesce("sidecar_ids", empty).alias("sidecar_ids"), neural.alias("neural_model_calls"), "graph_targets_inserted", F.size(F.coalesce("sidecar_ids", empty)).alias("context_items_attached"),
    )


def complete_runs(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """question_id, path_id, status, error_code for all six paths of every question; one without a run failed in the first stage."""
    paths = F.explode(F.array(*[F.lit(p) for p in MODULES])).alias("path_id")
    each = questions.select("question_id").distinct().select("question_id", paths)
    joined = each.join(runs.select("question_id", "path_id", "status"), ["question_id", "path_id"], "left")
    missing = F.col("status").isNull()
    return joined.select("question_id", "path_id", F.coalesce("status", F.lit("execution_error")).alias("status"), F.when(missing, F.lit("E_FIRST_STAGE")).alias("error_code"))


def run_issues(units: DataFrame, attached: DataFrame) -> DataFrame:
    """(question_id, path_id, code): broken rank sequences, repeated evidence or sidecars, modules that a path must not use.

    Both inputs carry path_id.
    """
    key = ["question_id", "path_id"]
    sums = units.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("source_id").alias("named"), F.max("rank").alias("top"), F.count_distinct("rank").alias("ranks"), F.count_distinct("source_id").alias("ids"), F.count_if(F.col("origin") == "graph").alias("graph"))
    side = attached.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.count_distinct("sidecar_id").alias("sids"))
    both = sums.join(side, key, "left").fillna(0, ["m", "sids"])
    no_context = [p for p, m in MODULES.items() if not m[1]]
    no_graph = [p for p, m in MODULES.items() if not m[2]]
    codes = F.array_compact(
        F.array(
            F.when((F.col("top") != F.col("n")) | (F.col("ranks") != F.col("n")), F.lit("E_RANK_SEQUENCE")),
            F.when(F.col("ids") != F.col("named"), F.lit("E_EVIDENCE_ID_DUPLICATE")),
            F.when(F.col("sids") != F.col("m"), F.lit("E_SIDECAR_ID_DUPLICATE")),
            F.when((F.col("m") > 0) & F.col("path_id").isin(*no_context), F.lit("E_PATH_CONTEXT_FORBIDDEN")),
            F.when((F.col("graph") > 0) & F.col("path_id").isin(*no_graph), F.lit("E_PATH_GRAPH_FORBIDDEN")),
        )
    )
    return both.select(*key, F.explode(codes).alias("code"))
