"""From labels to outcomes, summaries, policies and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text
from lodestrand.operators.structure import MODULES

# Neural calls, graph targets and context items that a path may use.
BUDGETS = {"P0": (0, 0, 0), "P1": (1, 0, 0), "P2": (0, 0, 15), "P3": (0, 5, 0), "P4": (1, 0, 15), "P5": (1, 5, 15)}
#: Steps whose effect is read from pairs of paths that differ in one module.
STAGES = (("reranking", "P0", "P1"), ("context", "P0", "P2"), ("context", "P1", "P4"), ("graph", "P0", "P3"), ("graph", "P4", "P5"))
# The cue words of either kind, both languages.
TABLE_CUES = ["表", "表格", "附表", "附录", "栏", "行", "列", "上下文", "上级条款", "table", "tabulated", "appendix", "annex", "column", "row", "context", "parent section"]
CITATION_CUES = [
    "引用", "参照", "依据", "按照", "依照", "见", "依赖", "cite", "cited", "citation", "refer to", "according to", "in accordance with", "as defined in", "required by", "depends on",
]
KEY = ["question_id", "path_id"]


def path_outcomes(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """One row a question and path with a spec: what its labelled evidence achieves.

    specs: question_id, domain, category, required (array), insufficient. Evidence is complete if every required source was
    retrieved; without required sources, if one label is SUFFICIENT; never for insufficiency candidates. One HARMFUL
    label makes the expansion harmful. Grouping meets the specs after aggregation, so a hot question costs one row.
    """
    seen = labels.groupBy(*KEY).agg(
        F.collect_set(F.regexp_extract("evidence_id", "^([^:]*)", 1)).alias("ids"), F.bool_or(F.col("label") == "HARMFUL").alias("harmful_expansion"),
        F.bool_or(F.col("label") == "SUFFICIENT").alias("sufficient_found"), F.count_if(F.col("evidence_kind") == "sidecar").alias("context_items_attached"), F.count(F.lit(1)).alias("evidence_count"),
    )
    joined = seen.join(specs, "question_id")
    found = F.size(F.array_intersect("ids", "required"))
    needed = F.size("required")
    complete = F.when(F.col("insufficient"), False).when(needed > 0, found == needed).otherwise(F.col("sufficient_found"))
    return joined.select(
        *KEY, "domain", "category", complete.alias("evidence_complete"), "harmful_expansion", (complete & ~F.col("harmful_expansion")).alias("combined_path_success"),
        found.alias("required_found_count"), needed.alias("required_total_count"), "sufficient_found", "context_items_attached", "evidence_count",
    )


def _rates() -> list[Column]:
    flags = ("evidence_complete", "harmful_expansion", "combined_path_success")
    counts = [F.count_if(f).alias(f"{f}_count") for f in flags]
    return [F.count(F.lit(1)).alias("question_path_count"), *counts, *[F.round(F.avg(F.col(f).cast("double")), 9).alias(f"{f}_rate") for f in flags]]


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Counts and rates by path, over all domains and by domain, from one pass over grouping sets."""
    sets = outcomes.groupingSets([["path_id"], ["domain", "path_id"]], "domain", "path_id")
    mean = F.round(F.avg("context_items_attached"), 9).alias("mean_context_items_attached")
    out = sets.agg(F.grouping("domain").alias("_g"), *_rates(), mean)
    return out.withColumn("domain", F.when(F.col("_g") == 1, "all").otherwise(F.col("domain"))).drop("_g")


def stratum_summary(outcomes: DataFrame) -> DataFrame:
    """Counts and rates by domain, category and path."""
    return outcomes.groupBy("domain", "category", "path_id").agg(*_rates())


def wide(outcomes: DataFrame, flag: str = "combined_path_success") -> DataFrame:
    """One row a question with the flag of each path, false where a path is missing."""
    return outcomes.groupBy("question_id").agg(*[F.coalesce(F.bool_or(F.when(F.col("path_id") == p, F.col(flag))), F.lit(False)).alias(p) for p in MODULES])


def stage_rescues(outcomes: DataFrame) -> DataFrame:
    """How often each step turns failure into success and success into failure, by domain and category."""
    keys = outcomes.select("question_id", "domain", "category").distinct()
    rows = wide(outcomes).join(keys, "question_id")
    steps = F.explode(F.array(*[F.struct(F.lit(m).alias("module"), F.lit(a).alias("before"), F.lit(b).alias("after"), F.col(a).alias("x"), F.col(b).alias("y")) for m, a, b in STAGES])).alias("s")
    return rows.select("domain", "category", steps).groupBy("domain", "category", "s.module", "s.before", "s.after").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("s.x") & F.col("s.y")).alias("rescued"), F.count_if(F.col("s.x") & ~F.col("s.y")).alias("lost")
    )


MEDIAN_SLICES = 1_000


def path_costs(runtimes: DataFrame) -> DataFrame:
    """path_id, budgets and the exact median of runtime_ms: one row a path.

    Equal runtimes are counted first. The slice of values (by their place between least and most) that holds the middle is found from
    the counts of MEDIAN_SLICES slices a path, and only within slices are values put in order. Null and non-finite runtimes don't count.
    """
    known = runtimes.where(F.col("path_id").isin(*BUDGETS) & F.col("runtime_ms").isNotNull() & ~F.isnan(F.col("runtime_ms").cast("double")) & (F.abs(F.col("runtime_ms").cast("double")) < float("inf")))
    counts = known.groupBy("path_id", F.col("runtime_ms").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("path_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("all"))  # one row a path
    place = F.coalesce(F.least(F.lit(MEDIAN_SLICES - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * MEDIAN_SLICES)), F.lit(0)).cast("int")
    cut = counts.join(F.broadcast(ends), "path_id").withColumn("s", place)
    slices = cut.groupBy("path_id", "s").agg(F.sum("n").alias("sn"))  # at most MEDIAN_SLICES rows a path
    before = slices.select("path_id", "s", (F.sum("sn").over(Window.partitionBy("path_id").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sn")).alias("b"))
    upto = F.col("b") + F.sum("n").over(Window.partitionBy("path_id", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cut.join(F.broadcast(before), ["path_id", "s"]).withColumn("u", upto)
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    at = lambda k: F.max(F.when((F.col("u") >= k) & (F.col("u") - F.col("n") < k), F.col("v")))
    medians = ranked.groupBy("path_id").agg(((at(low) + at(high)) / 2).alias("median_runtime_ms"))
    budget = lambda k: F.element_at(F.create_map(*[F.lit(x) for p, b in BUDGETS.items() for x in (p, b[k])]), F.col("path_id"))
    return medians.select("path_id", budget(0).alias("neural_model_calls"), budget(1).alias("graph_targets"), budget(2).alias("context_items"), "median_runtime_ms")


def cost_order() -> Column:
    """Costs compare in this order, the path breaking ties."""
    return F.struct("neural_model_calls", "graph_targets", "context_items", "median_runtime_ms", "path_id")


def oracle_policy(outcomes: DataFrame, costs: DataFrame) -> DataFrame:
    """The cheapest successful path of each question; none: abstained and not routable. costs has one row a path (broadcast)."""
    joined = outcomes.join(F.broadcast(costs), "path_id")
    best = joined.groupBy("question_id").agg(F.min(F.when(F.col("combined_path_success"), cost_order())).alias("b"))
    return best.select("question_id", F.col("b.path_id").alias("selected_path_id"), F.col("b").isNull().alias("abstained"), F.col("b").isNotNull().alias("routable"))


def constant_policies(questions: DataFrame) -> DataFrame:
    """P0 and P5 for every question."""
    each = F.explode(F.array(F.struct(F.lit("bm25").alias("policy_id"), F.lit("P0").alias("p")), F.struct(F.lit("all_modules").alias("policy_id"), F.lit("P5").alias("p")))).alias("x")
    return questions.select("question_id", each).select("question_id", "x.policy_id", F.col("x.p").alias("selected_path_id"))


def top_scores(stage: DataFrame, depth: int = 10) -> DataFrame:
    """question_id and its best first-stage scores, highest first: at most `depth` numbers a question."""
    kept = stage.where((F.col("bm25_rank") <= depth) & F.col("bm25_score").isNotNull())
    return kept.groupBy("question_id").agg(F.sort_array(F.collect_list("bm25_score"), asc=False).alias("scores"))


def gap(scores: str, position: int) -> Column:
    """How far the score at a position (from 0) lies below the first, relative to it; 0 if there are too few."""
    first = F.try_element_at(scores, F.lit(1))
    other = F.try_element_at(scores, F.lit(position + 1))
    return F.coalesce((first - other) / F.greatest(F.abs(first), F.lit(1e-9)), F.lit(0.0))


def entropy(scores: str) -> Column:
    """The natural-log entropy of the softmax of the scores; 0 without scores."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.coalesce(-F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top) / total * (x - top - F.log(total))), F.lit(0.0))


def heuristic_policy(questions: DataFrame, scores: DataFrame, threshold: float = 0.15) -> DataFrame:
    """A path for each question with two scores or more, by its cue words and the gap of its two best scores."""
    normal = text.normalized("query_text", "cue")
    rows = questions.join(scores.where(F.size("scores") > 1), "question_id").select("question_id", text.contains_any(normal, TABLE_CUES).alias("t"), text.contains_any(normal, CITATION_CUES).alias("c"), gap("scores", 1).alias("g"))
    path = F.when(F.col("t") & F.col("c"), "P5").when(F.col("c"), "P3").when(F.col("t"), "P2").when(F.col("g") < threshold, "P1").otherwise("P0")
    return rows.select("question_id", path.alias("selected_path_id"))


# What is known only after a path has run.
FORBIDDEN = {"reranker_score", "reranker_agreement", "executed_overlap", "retrieved_target_properties", "ranked_units", "context_sidecars"}


def route_features(questions: DataFrame, scores: DataFrame, metadata: DataFrame, costs: DataFrame) -> DataFrame:
    """One row a question and path of what is known before any path runs; later information is refused by column name."""
    late = FORBIDDEN & (set(questions.columns) | set(metadata.columns))
    if late:
        raise ValueError(f"features cannot use {sorted(late)}")
    normal = text.normalized("query_text", "cue")
    shared = questions.join(scores.where(F.size("scores") > 1), "question_id").join(metadata, "question_id", "left").select(
        "question_id", "domain", F.coalesce(F.length(normal), F.lit(0)).alias("query_length"), F.round(F.col("scores")[0], 6).alias("bm25_top_score"), F.round(gap("scores", 1), 6).alias("bm25_gap_1_2"),
        F.round(gap("scores", 4), 6).alias("bm25_gap_1_5"), F.round(entropy("scores"), 6).alias("bm25_top10_entropy"), text.contains_any(normal, TABLE_CUES).cast("int").alias("has_table_context_cue"),
        text.contains_any(normal, CITATION_CUES).cast("int").alias("has_citation_dependency_cue"), F.coalesce("eligible_outgoing_edge_count", F.lit(0)).alias("eligible_outgoing_edge_count"),
        F.coalesce("max_edge_confidence", F.lit(0.0)).alias("max_edge_confidence"),
    )
    priced = costs.select("path_id", F.col("neural_model_calls").alias("cost_neural_calls"), F.col("graph_targets").alias("cost_graph_targets"), F.col("context_items").alias("cost_context_items"), F.col("median_runtime_ms").alias("cost_median_runtime_ms"))
    return shared.crossJoin(F.broadcast(priced))  # one row a path


def selective_routes(probabilities: DataFrame, costs: DataFrame, threshold: float | None, thresholds: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """The cheapest path of each question whose probability reaches the threshold, else abstention; and the route taken without abstention.

    probabilities: question_id, path_id, p. Without a threshold every question abstains and, unabstaining, takes the
    likeliest path (the threshold counts as 1). With `thresholds` (by, threshold; one row a group) each group has its own.
    """
    joined = probabilities.join(F.broadcast(costs), "path_id")
    keys = ["question_id"] + ([by] if by else [])
    if thresholds is not None:
        joined = joined.join(F.broadcast(thresholds.select(by, F.col("threshold").alias("_t"))), by, "left")
    else:
        joined = joined.withColumn("_t", F.lit(threshold).cast("double"))
    enough = F.col("p") >= F.coalesce("_t", F.lit(float("inf")))
    fallback = F.col("p") >= F.coalesce("_t", F.lit(1.0))
    best = joined.groupBy(*keys).agg(
        F.min(F.when(enough, cost_order())).alias("b"), F.min(F.when(fallback, cost_order())).alias("f"), F.min(F.struct((-F.col("p")).alias("np"), cost_order().alias("c"))).alias("m")
    )
    return best.select(*keys, F.col("b.path_id").alias("selected_path_id"), F.col("b").isNull().alias("abstained"), F.coalesce("f.path_id", "m.c.path_id").alias("no_abstention_path_id"))


def threshold_table(probabilities: DataFrame, outcomes: DataFrame, costs: DataFrame, by: str | None = None) -> DataFrame:
    """(threshold, accepted, failures): for every distinct probability, how many questions take a path and how many of these fail.

    A question's route changes only where its cheapest eligible path drops out: it takes path x for thresholds above the
    greatest probability of any cheaper path and up to p(x). So each (question, path) is an interval, and counts by
    threshold are running sums over interval ends: two aggregations and prefix sums, no pairing of thresholds with questions.
    by: a column of the probabilities, each value of which has a table of its own; all are made in one plan.
    """
    keys = [by] if by else []
    rows = probabilities.join(outcomes.select(*KEY, F.col("combined_path_success").alias("ok")), KEY).join(F.broadcast(costs), "path_id")
    cheaper = Window.partitionBy("question_id", *keys).orderBy("neural_model_calls", "graph_targets", "context_items", "median_runtime_ms", "path_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.withColumn("above", F.max("p").over(cheaper)).where("above is null or p > above")
    ends = spans.select(*keys, F.explode(F.array(
        F.struct(F.col("p").alias("at"), F.lit(1).alias("n"), (~F.col("ok")).cast("int").alias("bad")),
        F.struct(F.col("above").alias("at"), F.lit(-1).alias("n"), (-(~F.col("ok")).cast("int")).alias("bad")),
    )).alias("e")).where("e.at is not null").groupBy(*keys, "e.at").agg(F.sum("e.n").alias("n"), F.sum("e.bad").alias("bad"))
    points = probabilities.select(*keys, F.col("p").alias("at")).distinct().join(ends, [*keys, "at"], "left")
    return _running_from_top(points.select(*keys, "at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")), keys)


SLICES = 1_000


def _running_from_top(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of n and bad over all points of a group at or above each one, taken in at most SLICES slices of the unit interval."""
    cut = points.withColumn("_s", F.least(F.lit(SLICES - 1), F.floor(F.col("at") * SLICES)).cast("int"))
    total = cut.groupBy(*keys, "_s").agg(F.sum("n").alias("sn"), F.sum("bad").alias("sb"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)  # over at most SLICES rows
    offsets = total.select(*keys, "_s", F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("on"), F.coalesce(F.sum("sb").over(above), F.lit(0)).alias("ob"))
    inside = Window.partitionBy(*keys, "_s").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(F.broadcast(offsets), [*keys, "_s"]).select(
        *keys, F.col("at").alias("threshold"), (F.col("on") + F.sum("n").over(inside)).alias("accepted"), (F.col("ob") + F.sum("bad").over(inside)).alias("failures")
    )


def select_threshold(table: DataFrame, least: int = 10, most: float = 0.10, by: str | None = None) -> DataFrame:
    """One row (one a group with a valid threshold, if `by` names the groups): the smallest threshold with enough accepted questions and few enough failures, or forced abstention."""
    valid = table.where((F.col("accepted") >= least) & (F.col("failures") <= most * F.col("accepted") + 1e-12))
    keys = [by] if by else []
    best = valid.groupBy(*keys).agg(F.min_by(F.struct("threshold", "accepted", "failures"), "threshold").alias("b"))
    return best.select(
        *keys, F.col("b.threshold").alias("threshold"), F.col("b").isNull().alias("force_abstain"), F.coalesce("b.accepted", F.lit(0)).alias("accepted_count"), F.round(F.col("b.failures") / F.col("b.accepted"), 9).alias("failure_rate")
    )


def signals(outcomes: DataFrame, costs: DataFrame) -> DataFrame:
    """One row with the figures behind the first three signals, and whether each passes."""
    success, harm, complete = (wide(outcomes, f) for f in ("combined_path_success", "harmful_expansion", "evidence_complete"))
    rescued = lambda *pairs: F.count_if(_any(*[~F.col(a) & F.col(b) for a, b in pairs]))
    s = success.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("P0") & _any(*[F.col(f"P{k}") for k in range(1, 6)])).alias("rescued"), F.count_if("P0").alias("p0_success"),
        rescued(("P0", "P1")).alias("rescued_by_reranking"), rescued(("P0", "P2"), ("P1", "P4")).alias("rescued_by_context"), rescued(("P0", "P3"), ("P4", "P5")).alias("rescued_by_graph"),
    )
    oracle = oracle_policy(outcomes, costs).where("routable").join(F.broadcast(costs.select(F.col("path_id").alias("selected_path_id"), "neural_model_calls")), "selected_path_id")
    picked = outcomes.select("question_id", F.col("path_id").alias("selected_path_id"), F.col("harmful_expansion").alias("oh"), F.col("evidence_complete").alias("oc"))
    five = success.select("question_id", F.col("P5").alias("s5")).join(harm.select("question_id", F.col("P5").alias("h5")), "question_id").join(complete.select("question_id", F.col("P5").alias("c5")), "question_id")
    o = oracle.join(picked, ["question_id", "selected_path_id"]).join(five, "question_id").agg(
        F.count(F.lit(1)).alias("routable"), F.avg("neural_model_calls").alias("calls"), F.avg(F.col("s5").cast("int")).alias("s5"), F.avg(F.col("oh").cast("int")).alias("oh"),
        F.avg(F.col("h5").cast("int")).alias("h5"), F.avg(F.col("oc").cast("int")).alias("oc"), F.avg(F.col("c5").cast("int")).alias("c5"),
    )
    both = s.crossJoin(o)  # one row each
    modules = sum(((F.col(f"rescued_by_{m}") >= 5).cast("int") for m in ("reranking", "context", "graph")), F.lit(0))
    gain = F.col("routable") / F.col("questions") - F.col("p0_success") / F.col("questions")
    cheaper = (1.0 - F.col("s5") >= -0.02) & (1.0 - F.col("calls") / BUDGETS["P5"][0] >= 0.20)
    safer = (F.col("h5") - F.col("oh") >= 0.05) & (F.col("oc") - F.col("c5") >= -0.02)
    return both.select(
        "questions", "rescued", F.round(F.col("rescued") / F.col("questions"), 9).alias("rescued_fraction"), (F.col("rescued") / F.col("questions") >= 0.20).alias("signal_1"),
        "rescued_by_reranking", "rescued_by_context", "rescued_by_graph", (modules >= 2).alias("signal_2"), "routable", F.round("calls", 9).alias("oracle_mean_neural_calls"),
        F.round("h5", 9).alias("p5_harm_rate"), F.round("oh", 9).alias("oracle_harm_rate"), F.coalesce((gain >= 0.05) | cheaper | safer, F.lit(False)).alias("signal_3"),
    )


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
