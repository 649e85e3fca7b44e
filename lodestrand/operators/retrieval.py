"""Full-text retrieval: postings, BM25 scores, top-k, reranking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import ship_package

K1, B = 1.2, 0.75
#: Documents of which one task holds the postings at a time.
DOC_BLOCK = 32_768


def postings(docs: DataFrame, scope: str, doc: str, terms: str) -> DataFrame:
    """(scope, doc, term, weight): the BM25 weight of each term of each document within its scope.

    The number of documents and their average length count documents without terms too. Statistics are one row a scope
    and one a term.
    """
    sized = docs.select(scope, doc, terms, F.size(terms).alias("_len"))
    totals = sized.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg")).where("_avg > 0")
    tf = sized.select(scope, doc, "_len", F.explode(terms).alias("term")).groupBy(scope, doc, "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    df = tf.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1.0 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    norm = F.col("_tf") + K1 * (1.0 - B + B * F.col("_len") / F.col("_avg"))
    return tf.join(df, [scope, "term"]).join(totals, scope).select(scope, doc, "term", (idf * F.col("_tf") * (K1 + 1.0) / norm).alias("weight"))


def bm25_top(queries: DataFrame, docs: DataFrame, scope: str, query: str, doc: str, terms: str, k: int = 50) -> DataFrame:
    """(query, doc, rank, score): the k best documents with a positive score for each query, within its scope.

    Both sides bring their terms as arrays. Ties (to six places) go to the smaller document id. One exchange on (scope, term) meets
    queries and postings, one on the query ranks; partial sums and the group limit work before each.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must be between 1 and 1000")
    asked = queries.select(scope, query, F.explode(terms).alias("term")).groupBy(scope, query, "term").agg(F.count(F.lit(1)).alias("_qtf"))
    scored = (
        asked.join(postings(docs, scope, doc, terms), [scope, "term"])
        .groupBy(query, doc)
        .agg(F.round(F.sum(F.col("_qtf") * F.col("weight")), 6).alias("score"))
        .where("score > 0")
    )
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(query, doc, "rank", "score")


def _index(docs: list[tuple[str, list[str], list[float]]]) -> tuple[list[str], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Document ids in order, and for each term the places of its documents and their weights."""
    docs = sorted(docs, key=lambda d: d[0])
    sizes = [len(d[1]) for d in docs]
    place = np.repeat(np.arange(len(docs)), sizes)
    weight = np.concatenate([np.asarray(d[2], dtype=float) for d in docs]) if docs else np.empty(0)
    codes, names = pd.factorize(np.array([t for d in docs for t in d[1]], dtype=object))
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(names)))
    return [d[0] for d in docs], {t: (place[order[a:b]], weight[order[a:b]]) for t, a, b in zip(names, np.concatenate(([0], ends[:-1])).astype(int), ends, strict=True)}


def _scorer(k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, docs, ids, index = None, [], [], None
        for pdf in batches:
            out: list[tuple[str, str, float]] = []
            for scope, block, split, tag, name, terms, weights in zip(*(pdf[c] for c in ("_scope", "_block", "_split", "_tag", "_id", "_terms", "_weights")), strict=True):
                if (scope, block, split) != key:
                    key, docs, index = (scope, block, split), [], None
                if tag == 0:
                    docs.append((name, list(terms), weights))
                    continue
                if index is None:
                    ids, index = _index(docs)
                    docs = []
                total = np.zeros(len(ids))
                for term, count in Counter(terms).items():
                    if (found := index.get(term)) is not None:
                        total[found[0]] += count * found[1]
                total = np.round(total, 6)
                hits = np.flatnonzero(total > 0)
                if len(hits) > k:
                    least = np.partition(total[hits], len(hits) - k)[len(hits) - k]
                    hits = hits[total[hits] >= least]
                hits = hits[np.argsort(-total[hits], kind="stable")][:k]
                out += [(name, ids[h], float(total[h])) for h in hits]
            yield pd.DataFrame(out, columns=["_query", "_doc", "score"])

    return score


def bm25_top_blocked(queries: DataFrame, docs: DataFrame, scope: str, query: str, doc: str, terms: str, k: int = 50, block: int = DOC_BLOCK) -> DataFrame:
    """As bm25_top, scored by arrays: for batches of many queries.

    Nearly every question shares a common word with nearly every section, so joining postings with questions makes a row of
    nearly every pair. Here documents are put into blocks, a task keeps the postings of one block as arrays and lets
    all queries pass, each giving its k best of the block; only these are ranked against each other. What is moved is one row a
    document (for each split) and one a query and block, and no task holds more than a block.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must be between 1 and 1000")
    spark = docs.sparkSession
    ship_package(spark)
    lists = postings(docs, scope, doc, terms).groupBy(scope, doc).agg(F.collect_list("term").alias("_terms"), F.collect_list("weight").alias("_weights"))
    sizes = docs.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))  # one row a scope
    blocks = sizes.agg(F.sum("_blocks")).first()[0] or 0
    splits = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, blocks)))
    each = F.sequence(F.lit(0), F.lit(splits - 1))
    left = lists.join(sizes, scope).select(
        F.col(scope).alias("_scope"), F.pmod(F.xxhash64(doc), F.col("_blocks")).cast("int").alias("_block"), F.explode(each).alias("_split"), F.lit(0).alias("_tag"), F.col(doc).alias("_id"), "_terms", "_weights"
    )
    right = queries.where(F.size(terms) > 0).join(sizes, scope).select(
        F.col(scope).alias("_scope"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.pmod(F.xxhash64(query), F.lit(splits)).cast("int").alias("_split"), F.lit(1).alias("_tag"),
        F.col(query).alias("_id"), F.col(terms).alias("_terms"), F.array().cast("array<double>").alias("_weights"),
    )
    keys = ["_scope", "_block", "_split"]
    placed = left.unionByName(right).repartition(max(1, blocks) * splits, *keys).sortWithinPartitions(*keys, "_tag")
    found = placed.mapInPandas(_scorer(k), "_query string, _doc string, score double")
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), F.asc("_doc")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_query").alias(query), F.col("_doc").alias(doc), "rank", "score")


def first_stage(candidates: DataFrame, depth: int = 50) -> DataFrame:
    """The first `depth` candidates of each question, numbered anew as bm25_rank."""
    order = Window.partitionBy("question_id").orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last("score"), F.asc("source_id"))
    numbered = candidates.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= depth)
    return numbered.select("question_id", "source_id", "bm25_rank", F.col("score").alias("bm25_score"), "reranker_score")


def rerank(stage: DataFrame, limit: int = 10) -> DataFrame:
    """The best `limit` of each question by reranker score, then bm25_rank, then source_id; unscored ones come last."""
    order = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("reranker_score"), F.asc("bm25_rank"), F.asc("source_id"))
    return stage.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def direct(stage: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` of each question as retrieved, without a reranker score."""
    return stage.where(F.col("bm25_rank") <= limit).withColumn("reranker_score", F.lit(None).cast("double")).withColumn("rank", F.col("bm25_rank"))


def overlap_score(query_terms: str, doc_terms: str) -> Column:
    """A deterministic reranker in place of a neural one: the Jaccard similarity of two term sets."""
    both = F.size(F.array_intersect(query_terms, doc_terms))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(query_terms, doc_terms))), F.lit(0.0))


def rerank_scores(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], keys: list[str], query: str, doc: str, batch: int = 8) -> DataFrame:
    """keys and reranker_score of pairs of texts by any model: `load` gives the scorer and is called once a task, in the Python worker.

    The scorer takes lists of at most `batch` (query, document) texts and gives as many numbers in [0, 1]; anything else fails the task.
    Null texts are empty ones. Extra columns are ignored.
    """
    ship_package(pairs.sparkSession)
    wanted = pairs.select(*keys, F.coalesce(F.col(query), F.lit("")).alias("_q"), F.coalesce(F.col(doc), F.lit("")).alias("_d"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for pdf in batches:
            scorer = scorer or load()
            texts, out = list(zip(pdf["_q"], pdf["_d"], strict=True)), []
            for begin in range(0, len(texts), batch):
                part = texts[begin : begin + batch]
                got = [float(x) for x in scorer(part)]
                if len(got) != len(part) or not all(0.0 <= x <= 1.0 for x in got):
                    raise ValueError("a scorer must give one number in [0, 1] for each pair")
                out += got
            yield pdf[keys].assign(reranker_score=out)

    schema = T.StructType([*[f for f in wanted.select(*keys).schema.fields], T.StructField("reranker_score", T.DoubleType())])
    return wanted.mapInPandas(score, schema)


def rerank_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question_id, code) of a reranked stage (question_id, source_id, reranker_score) against the one it came from: sources lost, added or
    repeated, scores missing or outside the unit interval."""
    key = ["question_id", "source_id"]
    a, b = before.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), after.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.coalesce(F.col("reranker_score").between(0, 1) & ~F.isnan("reranker_score"), F.lit(False))).alias("bad"))
    sums = a.join(b, key, "full").groupBy("question_id").agg(F.count_if(F.col("m").isNull()).alias("lost"), F.count_if(F.col("n").isNull()).alias("added"), F.count_if(F.col("m") > F.col("n")).alias("repeated"), F.sum("bad").alias("bad"))
    codes = F.array_compact(F.array(
        F.when(F.col("lost") > 0, F.lit("E_SOURCE_LOST")), F.when(F.col("added") > 0, F.lit("E_SOURCE_ADDED")), F.when(F.col("repeated") > 0, F.lit("E_EVIDENCE_ID_DUPLICATE")), F.when(F.col("bad") > 0, F.lit("E_RERANKER_SCORE")),
    ))
    return sums.select("question_id", F.explode(codes).alias("code"))


def first_stage_issues(stage: DataFrame, depth: int = 50) -> DataFrame:
    """(question_id, code): questions whose first stage has too many rows, gaps in its ranks or repeated sources."""
    sums = stage.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("source_id").alias("named"), F.max("bm25_rank").alias("top"), F.min("bm25_rank").alias("low"), F.count_distinct("bm25_rank").alias("ranks"), F.count_distinct("source_id").alias("sources")
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("n") > depth, F.lit("E_DEPTH")),
            F.when((F.col("low") != 1) | (F.col("top") != F.col("n")) | (F.col("ranks") != F.col("n")), F.lit("E_RANK_SEQUENCE")),
            F.when(F.col("sources") != F.col("named"), F.lit("E_EVIDENCE_ID_DUPLICATE")),
        )
    )
    return sums.select("question_id", F.explode(codes).alias("code"))


def domain_issues(stage: DataFrame, sections: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, code): questions with a candidate that states another domain than theirs, or whose section is of another.

    `stage` carries question_id, source_id and domain, the others one row an id with its domain. Unknown domains match any. Domains are
    gathered by question before questions are joined, so a hot question is one row there.
    """
    known = sections.select("source_id", F.col("domain").alias("_s"))
    own = stage.join(known, "source_id", "left").groupBy("question_id").agg(F.array_union(F.collect_set("domain"), F.collect_set("_s")).alias("_found"))
    crossed = own.join(questions.select("question_id", "domain"), "question_id").where(F.exists("_found", lambda d: d != F.col("domain")))
    return crossed.select("question_id", F.lit("E_DOMAIN").alias("code"))
