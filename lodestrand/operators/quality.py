"""Contracts of records and tables: rules by record, checks across tables, fingerprints, privacy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTIFIER = r"^[^\x00-\x1f\x7f]{1,128}$"


def violations(df: DataFrame, entity: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """(entity, record_id, code) for each record and each rule that it breaks; a rule that gives null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))
    return df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("record_id"), F.explode(broken).alias("code")).distinct()


def identifier(name: str) -> Column:
    """Whether a value is an identifier: 1 to 128 characters, none a control character."""
    return F.col(name).rlike(IDENTIFIER)


def unique_items(name: str, most: int = 20) -> Column:
    """Whether a list has at most `most` items, all different."""
    return (F.size(F.array_distinct(name)) == F.size(name)) & (F.size(name) <= most)


def delivered_twice(df: DataFrame, key: str) -> DataFrame:
    """Keys of which there is more than one row, with the number of rows."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("record_id")).agg(F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


def changed_on_redelivery(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(record_id, field): immutable fields that differ between deliveries of a record. One aggregation, nothing joined."""
    sums = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("record_id")).agg(
        *[(F.min(F.hash(f)) != F.max(F.hash(f))).alias(f) for f in fields]
    )
    changed = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in fields]))
    return sums.select("record_id", F.explode(changed).alias("field"))


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has; each side is reduced to its keys before they meet."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").select(key, F.lit(side).alias("side"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def import_issues(baseline: DataFrame, reviewed: DataFrame, key: str, immutable: tuple[str, ...], label: str, labels: tuple[str, ...], reason: str, needs_reason: str, identity: str) -> DataFrame:
    """(key, code) of reviewed rows against the exported ones: missing, unknown or repeated rows, changed fields, a wrong identity
    hash, a label that isn't one, and a reason that is missing or out of place. Both sides have the immutable fields and the hash.
    """
    own = baseline.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in immutable], F.col(identity).alias("b_hash"), F.lit(True).alias("_b"))
    seen = reviewed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in dict.fromkeys((*immutable, identity, label, reason))])
    both = own.join(seen, key, "full")
    here = F.col("_b") & F.col("_n").isNotNull()
    given = F.upper(F.trim(label))
    same = F.lit(True)
    for c in immutable:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    has_reason = F.coalesce(F.trim(reason), F.lit("")) != ""
    codes = F.array_compact(F.array(
        F.when(F.col("_n").isNull(), F.lit("E_ROW_MISSING")), F.when(F.col("_b").isNull(), F.lit("E_ROW_UNKNOWN")), F.when(F.col("_n") > 1, F.lit("E_ROW_REPEATED")),
        F.when(here & ~same, F.lit("E_FIELD_CHANGED")), F.when(here & ~F.col(identity).eqNullSafe(F.col("b_hash")), F.lit("E_IDENTITY_HASH")),
        F.when(here & ~F.coalesce(given.isin(*labels), F.lit(False)), F.lit("E_LABEL")), F.when(here & (F.coalesce(given == needs_reason, F.lit(False)) != has_reason), F.lit("E_REASON")),
    ))
    return both.select(key, F.explode(codes).alias("code"))


def authoring_issues(questions: DataFrame, sections: DataFrame, edges: DataFrame, evidence: DataFrame, confidence: float = 0.85) -> DataFrame:
    """(question_id, code) of questions against the sections that they were written from.

    questions: question_id, domain, category, authoring_source_ids. A question can resolve its authoring sources (those that exist
    and are of its domain), what stands around them (headings, parents, tables of their documents) and what they relate to with
    enough confidence. evidence (question_id, source_id) has to be among these, and to be of the kind that the category
    asks for. Questions of insufficient evidence need no sources and are not checked. Null ids in lists are ignored.

    Tables are looked up from the evidence, so no section is paired with all tables of its document.
    """
    ids = F.array_distinct(F.array_compact(F.coalesce("authoring_source_ids", F.array().cast("array<string>"))))
    checked = questions.where(F.coalesce(F.col("category") != "evidence_insufficient", F.lit(True))).select("question_id", "domain", "category", ids.alias("ids"))
    named = sections.select("source_id", F.col("domain").alias("_d"), "document_id", "section_number", (F.coalesce(F.trim("heading"), F.lit("")) != "").alias("headed"))
    rows = checked.select("question_id", "domain", F.explode("ids").alias("source_id")).join(named.withColumn("found", F.lit(True)), "source_id", "left")
    fits = F.coalesce(F.col("_d") == F.col("domain"), F.lit(False))
    anchors = rows.where(F.col("found") & fits).select("question_id", "source_id", "document_id", "section_number", "headed")
    numbered = sections.where("document_id is not null and section_number is not null").groupBy("document_id", F.col("section_number").alias("number")).agg(F.min("source_id").alias("id"))
    parent = F.nullif(F.regexp_replace("section_number", r"\.?[0-9]+$", ""), F.lit(""))
    parents = anchors.select("question_id", "source_id", "document_id", parent.alias("number")).join(numbered, ["document_id", "number"]).where("id <> source_id")
    around = [anchors.select("question_id", F.col("source_id").alias("id"), F.lit("anchor").alias("k")), anchors.where("headed").select("question_id", F.col("source_id").alias("id"), F.lit("context").alias("k")), parents.select("question_id", "id", F.lit("context").alias("k"))]
    around.append(anchors.join(edges.where(F.col("confidence") >= confidence).select("source_id", "target_id"), "source_id").select("question_id", F.col("target_id").alias("id"), F.lit("graph").alias("k")))
    used = evidence.where("question_id is not null").select("question_id", F.col("source_id").alias("id")).distinct()
    notes = sections.where("source_type = 'table_note' and document_id is not null").select(F.col("source_id").alias("id"), "document_id")
    around.append(used.join(notes, "id").join(anchors.select("question_id", "source_id", "document_id"), ["question_id", "document_id"]).where("source_id <> id").select("question_id", "id", F.lit("table").alias("k")))
    near = reduce(DataFrame.unionByName, around).distinct()
    of = lambda k: F.coalesce(F.bool_or(F.col("k") == k), F.lit(False)).alias(k)
    hits = used.join(near, ["question_id", "id"], "left").groupBy("question_id", "id").agg(F.count("k").alias("kinds"), *[of(k) for k in ("anchor", "context", "graph", "table")])
    sums = hits.groupBy("question_id").agg(F.bool_or(F.col("kinds") == 0).alias("missing"), F.bool_and("anchor").alias("direct"), *[F.bool_or(k).alias(k) for k in ("context", "graph", "table")])
    per = rows.groupBy("question_id").agg(F.bool_or(F.col("found").isNull()).alias("lost"), F.bool_or(F.col("found") & ~fits).alias("crossed"))
    both = checked.join(per, "question_id", "left").join(sums, "question_id", "left")
    some, no = F.size("ids") > 0, lambda c: ~F.coalesce(F.col(c), F.lit(False))
    codes = F.array_compact(F.array(
        F.when(~some, F.lit("E_AUTHORING_SOURCE_MISSING")), F.when(F.col("lost"), F.lit("E_AUTHORING_SOURCE_UNRESOLVED")), F.when(F.col("crossed"), F.lit("E_AUTHORING_SOURCE_DOMAIN")),
        F.when(some & F.col("missing"), F.lit("E_EVIDENCE_SOURCE_UNRESOLVED")), F.when(some & (F.col("category") == "direct_clause") & ~F.coalesce("direct", F.lit(True)), F.lit("E_DIRECT_STRUCTURE")),
        F.when(some & (F.col("category") == "parent_heading_context") & no("context"), F.lit("E_CONTEXT_STRUCTURE")), F.when(some & (F.col("category") == "table_related") & no("table"), F.lit("E_TABLE_STRUCTURE")),
        F.when(some & (F.col("category") == "citation_dependency") & no("graph"), F.lit("E_GRAPH_STRUCTURE")),
    ))
    return both.select("question_id", F.explode(codes).alias("code"))


def quota_counts(records: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected, actual: cells of the quotas with their counts, empty ones included, and cells that no quota names."""
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    return quotas.join(counts, keys, "full").select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))


def fingerprint(df: DataFrame, columns: list[str], component: str, levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """One row (component, rows, sha256) that depends on the rows but not on their order: a hash tree.

    Rows are hashed where they are and grouped by their first digits, level by level: 16**6 leaves hold hashes only, so that 1e11 rows
    make about 6,000 in a leaf, and no node has more than 4,096 below it.
    """
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    hashed = df.select(F.sha2(text, 256).alias("h"))
    leaves = hashed.groupBy(F.substring("h", 1, levels[0]).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("leaf"))
    for digits in levels[1:]:
        below = F.transform(F.array_sort(F.collect_list(F.struct("s", "leaf"))), lambda x: x["leaf"])
        leaves = leaves.groupBy(F.substring("s", 1, digits).alias("_s")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(below, ""), 256).alias("leaf")).withColumnRenamed("_s", "s")
    root = leaves.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "leaf"))), lambda x: x["leaf"]), ""), 256).alias("sha256"))
    return root.select(F.lit(component).alias("component"), F.coalesce("rows", F.lit(0)).alias("rows"), "sha256")


def fingerprints(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row a component."""
    return reduce(DataFrame.unionByName, [fingerprint(df, columns, name) for name, (df, columns) in parts.items()])


def chain_breaks(entries: DataFrame, ledger: str, order: str, own: str, previous: str) -> DataFrame:
    """Entries of a ledger whose `previous` isn't the `own` of the entry before them (null for the first)."""
    before = F.lag(own).over(Window.partitionBy(ledger).orderBy(order))
    return entries.withColumn("_before", before).where(~F.col(previous).eqNullSafe(F.col("_before"))).drop("_before")


# Machine-local paths, and assignments that look like credentials, with the exemptions.
ABSOLUTE_PATH = r"(?i:\b[A-Z]:\\(?:Users|Projects)\\)|(?:^|[^A-Za-z0-9_])/(?:home|Users)/[^/\s]+/"
SECRET = r"""(?im)^[ \t]*(?:export[ \t]+)?([A-Z0-9_]*(?:PASSWORD|API_KEY|SECRET|TOKEN)[A-Z0-9_]*)[ \t]*[:=][ \t]*["']?([^\s#"'{}<>]+)"""
SAFE_VALUES = ("", "changeme", "change-me", "example", "none", "null", "placeholder", "redacted")
SAFE_KEYS = ("false_token", "maximum_input_tokens", "tokenizer_revision", "true_token")
NAMED_SECRET = r"^[A-Z][A-Z0-9_]*(?:PASSWORD|API_KEY|SECRET|TOKEN)[A-Z0-9_]*$"
# Names, suffixes and folders that must not be shared.
RESTRICTED_NAMES = (".env", "local.yaml", "local.yml")
RESTRICTED_SUFFIXES = (".7z", ".backup", ".bak", ".db", ".dump", ".faiss", ".pkl", ".sqlite", ".sqlite3", ".tar", ".zip")
RESTRICTED_PARTS = ("corpus", "model_cache", "neo4j_docker_data", "private", "raw")


def path_findings(df: DataFrame, path: str, size: str, max_bytes: int = 5_000_000) -> DataFrame:
    """(path, rule) of files that are restricted by name, suffix or folder, or too large."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    found = F.array_compact(F.array(
        F.when(name.isin(*RESTRICTED_NAMES), F.lit("restricted-name")), F.when(suffix.isin(*RESTRICTED_SUFFIXES), F.lit("restricted-suffix")),
        F.when(F.arrays_overlap(parts, F.array(*[F.lit(p) for p in RESTRICTED_PARTS])), F.lit("restricted-directory")), F.when(F.col(size) > max_bytes, F.lit("oversize-file")),
    ))
    return df.select(F.col(path).alias("path"), F.explode(found).alias("rule"))


def privacy_findings(df: DataFrame, path: str, text: str, max_bytes: int = 1 << 20) -> DataFrame:
    """(path, rule): machine-local paths, credential-like assignments, text that isn't UTF-8 or too large. One finding a rule and record."""
    keys = F.regexp_extract_all(text, F.lit(SECRET), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(SECRET), F.lit(2))
    def suspicious(p: Column) -> Column:
        key, value = F.lower(p["0"]), p["1"]
        exempt = key.endswith("tokens") | key.startswith("_") | key.endswith("_env") | key.isin(*SAFE_KEYS) | value.rlike(NAMED_SECRET) | value.startswith("$") | F.lower(value).isin(*SAFE_VALUES)
        return ~exempt

    found = F.array_compact(F.array(
        F.when(F.col(text).rlike(ABSOLUTE_PATH), F.lit("absolute-path")),
        F.when(F.exists(F.arrays_zip(keys, values), suspicious), F.lit("possible-secret")),
        F.when(~F.is_valid_utf8(text), F.lit("not-utf8")),
        F.when(F.octet_length(text) > max_bytes, F.lit("oversize-file")),
    ))
    return df.select(F.col(path).cast("string").alias("path"), F.explode(found).alias("rule"))
