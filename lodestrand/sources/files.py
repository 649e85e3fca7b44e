"""Readers of corpora and graphs in files, and directory hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import slug

CHUNKS = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "doc_id", "heading", "parents_context", "content")])
TABLES = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "table", "table_summary")])
NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("properties", T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("doc_id", T.StringType())]))])
EDGES = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
# Relations that count, with their normal form.
RELATIONS = {
    "REFERENCES": "CITES",
    "REQUIRES_COMPLIANCE_WITH": "DEPENDS_ON",
    "APPLIES_DEFINITION_FROM": "DEPENDS_ON",
    "USES_PRINCIPLES_FROM": "DEPENDS_ON",
    "INTERPRETS": "DEPENDS_ON",
}


def read_json_lists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON files that each hold a list, with the file's name; a file that isn't JSON fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_name").alias("_file"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).where(F.coalesce(*[F.col(f.name).isNotNull().cast("int") for f in schema.fields]).isNotNull())


def unknown_keys(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(line, key): keys of JSON lines that the schema doesn't declare."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    known = F.array(*[F.lit(n) for n in schema.fieldNames()])
    return lines.select(F.col("value").alias("line"), F.explode(F.array_except(F.json_object_keys("value"), known)).alias("key"))


def corpus_issues(chunks: DataFrame, expected: int | None = None) -> DataFrame:
    """(code, records): chunks without id or document, repeated ids, and a count other than expected."""
    sums = chunks.agg(
        F.count_if(F.coalesce(F.trim("chunk_id"), F.lit("")) == "").alias("E_CHUNK_ID"), F.count_if(F.coalesce(F.trim("doc_id"), F.lit("")) == "").alias("E_DOC_ID"),
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("E_CHUNK_DUPLICATE"), (F.lit(0) if expected is None else F.abs(F.count(F.lit(1)) - expected)).alias("E_RECORD_COUNT"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("bigint").alias("records")) for c in sums.columns])
    return sums.select(F.explode(pairs).alias("p")).select("p.*").where("records > 0")


def sections_of_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks in the columns of sections; null text is empty."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return chunks.select(F.col("chunk_id").alias("source_id"), F.lit("pharmaceutical").alias("domain"), F.col("doc_id").alias("document_id"), text("heading").alias("heading"), text("content").alias("content"), text("parents_context").alias("parents_context"))


def context_of_chunks(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """(seed_source_id, context_type, kind, context_id, source_id, content) from heading, parents and tables of chunks.

    Tables are numbered in file order, blank ones included but not given out; their text is the summary, else the table.
    """
    part = lambda c, kind, name: sections.where(F.col(c) != "").select(F.col("source_id").alias("seed_source_id"), F.lit(name).alias("context_type"), F.lit(kind).alias("kind"), F.concat("source_id", F.lit(f":{name}")).alias("context_id"), "source_id", F.col(c).alias("content"))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("_file", "_at"))
    known = tables.withColumn("_at", F.monotonically_increasing_id()).join(sections.select(F.col("source_id").alias("chunk_id")), "chunk_id", "left_semi").withColumn("n", place)
    body = F.coalesce(F.nullif(F.trim("table_summary"), F.lit("")), F.trim("table"))
    rows = known.select(F.col("chunk_id").alias("seed_source_id"), F.lit("table").alias("context_type"), F.lit(2).alias("kind"), F.concat("chunk_id", F.lit(":table:"), F.col("n").cast("string")).alias("context_id"), F.col("chunk_id").alias("source_id"), body.alias("content"))
    return part("heading", 0, "heading_path").unionByName(part("parents_context", 1, "immediate_parent")).unionByName(rows.where("content <> ''"))


def edges_of_graph(nodes: DataFrame, edges: DataFrame, sections: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, confidence) of a property graph over chunks and documents.

    A target is a known chunk, or a document of exactly one chunk (others are ambiguous and dropped); a source document stands for
    all its chunks. Loops and repeated edges are dropped; confidence is 1.
    """
    chunk = sections.select(F.col("source_id").alias("chunk"), "document_id")
    resolved = nodes.select("id", F.col("properties.chunk_id").alias("c"), F.coalesce("properties.doc_id", F.element_at(F.split("id", ":"), -1)).alias("d"), (F.col("label") == "DocChunk").alias("is_chunk"))
    by_chunk = resolved.where("is_chunk").select("id", F.coalesce("c", "id").alias("chunk")).join(chunk.select("chunk"), "chunk", "left_semi")
    by_doc = resolved.where("not is_chunk").select("id", F.col("d").alias("document_id")).join(chunk, "document_id").select("id", "chunk")
    single = by_doc.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("chunk")).where("n = 1").select("id", "chunk")
    normal = F.element_at(F.create_map(*[F.lit(x) for p in RELATIONS.items() for x in p]), F.col("relation"))
    kept = edges.select("source", "target", normal.alias("relation")).where("relation is not null")
    sources = by_chunk.unionByName(by_doc).select(F.col("id").alias("source"), F.col("chunk").alias("source_id"))
    targets = by_chunk.select("id", "chunk").unionByName(single).select(F.col("id").alias("target"), F.col("chunk").alias("target_id"))
    joined = kept.join(sources, "source").join(targets, "target").where("source_id <> target_id")
    return joined.select("source_id", "target_id", "relation", F.lit(1.0).alias("confidence")).distinct()


def directory_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over name and content hash of the files of a directory, by name; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat(x["name"], F.lit("\t"), x["h"])), "\n")
    return files.agg(F.sha2(line, 256)).first()[0]


def read_scope_review(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a reviewed CSV with exactly these columns; a byte-order mark is skipped."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path)
    names = [c.lstrip("\ufeff") for c in df.columns]
    if names != columns:
        raise ValueError(f"expected columns {columns}, found {names}")
    return df.toDF(*names)


def scope_review_issues(review: DataFrame, decision: str = "decision", include: str = "inclusion_reason", exclude: str = "exclusion_reason") -> DataFrame:
    """(key, code) of reviewed rows: a decision that is neither INCLUDE nor EXCLUDE, or one without its reason."""
    made = F.upper(slug(decision))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    codes = F.array_compact(F.array(
        F.when(~F.coalesce(made.isin("INCLUDE", "EXCLUDE"), F.lit(False)), F.lit("E_DECISION")), F.when((made == "INCLUDE") & blank(include), F.lit("E_REASON")), F.when((made == "EXCLUDE") & blank(exclude), F.lit("E_REASON")),
    ))
    return review.select(F.col(review.columns[0]).alias("key"), F.explode(codes).alias("code"))
