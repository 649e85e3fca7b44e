"""Mixing sources to target weights (problem 8).

Capped water-filling gives each source a number of epochs; whole epochs repeat all its records, the fraction draws a
seeded part of them, measured in tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import slug as spelled
from lodestrand.llm import tokens
from lodestrand.session import materialize

#: Targets are worked on in the driver; they come from the table of targets, never from the records.
MAX_SOURCES = 10_000
KEY_BITS = 12


def water_fill(shares: dict[str, float], sizes: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """How much each source gives to a mix of `total`, at most size x cap.

    Sources whose part exceeds what they can give are clamped, and what they lack goes to the others by their shares,
    again and again, until nothing is exceeded or all are clamped.
    """
    most = {s: sizes.get(s, 0.0) * caps[s] for s in shares}
    given: dict[str, float] = {}
    while len(given) < len(shares):
        free = [s for s in shares if s not in given]
        left = max(0.0, total - sum(given.values()))
        weight = sum(shares[s] for s in free)
        part = {s: left * shares[s] / weight if weight > 0 else 0.0 for s in free}
        over = {s: most[s] for s in free if part[s] > most[s]}
        if not over:
            return given | part
        given |= over
    return given


def greatest_exact(shares: dict[str, float], sizes: dict[str, float], caps: dict[str, float]) -> float:
    """The greatest mix in which every source that has records reaches its share exactly.

    Shares of sources without records go to the others in proportion.
    """
    there = [s for s in shares if shares[s] > 0 and sizes.get(s, 0.0) * caps[s] > 0]
    weight = sum(shares[s] for s in there)
    return min((sizes[s] * caps[s] * weight / shares[s] for s in there), default=0.0)


def sized(df: DataFrame, doc: str, source: str, text: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(_d, _s, _n): document, source in one spelling, tokens of its text; without rows that have no doc or source."""
    rows = df.select(F.struct(F.col(doc).alias("d"), spelled(source).alias("s")).alias("_k"), F.col(text).alias("_t")).where(
        "_k.d is not null and length(_k.s) > 0"
    )
    counted = tokens.encode_corpus(rows, "_k", "_t", vocabulary)
    return counted.select("_k.d", "_k.s", F.size("ids").cast("bigint").alias("_n")).toDF("_d", "_s", "_n")


def mix(
    records: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", share: str = "target_share",
    repeats: str = "max_repeats", total: float | None = None, exact: bool = False, seed: int = 20260723,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of `records` as from `sized`.

    The mix has doc, source and repeats (1 or more). The report has for each target its share, the tokens there are, the
    tokens aimed at, epochs, the tokens and records in the mix, and the share reached. `total` is the size in tokens, by
    default that of all records of the target sources: sources too small for their part are clamped at max_repeats, and
    what they lack goes to the others. exact: the total is greatest_exact instead, so that no source is clamped.

    Sources match however they are spelled. Records whose source has no target, and those without tokens, are not in the
    mix. Null or negative shares and repeats count as 0, targets given twice add up their shares (and take the
    greater repeats). A document delivered twice counts once, with its greater size. Sources without records have
    0 everywhere and their share goes to the others. Empty tables give an empty mix.
    """
    goals = (
        targets.select(spelled(source).alias("_s"), F.col(source).alias("_name"), F.greatest(F.lit(0.0), F.coalesce(F.col(share).cast("double"), F.lit(0.0))).alias("_w"),
                       F.greatest(F.lit(0), F.coalesce(F.col(repeats).cast("int"), F.lit(0))).alias("_r"))
        .where("length(_s) > 0").groupBy("_s").agg(F.min("_name").alias("_name"), F.sum("_w").alias("_w"), F.max("_r").alias("_r"))
    )
    rows = {g["_s"]: g for g in goals.limit(MAX_SOURCES + 1).collect()}
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = records.sparkSession
    known = F.broadcast(spark.createDataFrame([(s,) for s in rows], "_s string"))
    key = F.xxhash64(F.lit(seed), "_d")
    one = records.where("_n > 0").join(known, "_s").groupBy("_d").agg(F.max(F.struct("_n", "_s")).alias("_x")).select("_d", "_x._s", "_x._n")
    one = one.withColumn("_k", key).withColumn("_b", F.shiftrightunsigned("_k", 64 - KEY_BITS).cast("int"))
    buckets = one.groupBy("_s", "_b").agg(F.sum("_n").alias("_t"))  # at most 2**KEY_BITS rows a source
    upward = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.select("_s", "_b", "_t", F.sum("_t").over(upward).alias("_upto"))
    sizes = {r["_s"]: float(r["_t"]) for r in buckets.groupBy("_s").agg(F.max("_upto").alias("_t")).collect()}
    shares, caps = {s: g["_w"] for s, g in rows.items()}, {s: float(g["_r"]) for s, g in rows.items()}
    if total is None:
        total = greatest_exact(shares, sizes, caps) if exact else sum(sizes.values())
    aimed = water_fill(shares, sizes, caps, total)
    plan = []
    for s, g in rows.items():
        size = sizes.get(s, 0.0)
        epochs = aimed[s] / size if size else 0.0
        whole = min(int(epochs + 1e-9), g["_r"])
        plan.append((s, g["_name"], g["_w"], int(size), g["_r"], float(aimed[s]), epochs, whole, max(0.0, aimed[s] - whole * size)))
    table = spark.createDataFrame(plan, "_s string, _name string, _w double, _size bigint, _r int, _aim double, _e double, _whole int, _part double")
    steps = F.broadcast(table.select("_s", "_name", "_whole", "_part"))
    # The bucket in which the fractional epoch ends; the records of buckets below it are taken, within it by order.
    cut = buckets.join(steps, "_s").where("_upto - _t < _part and _part <= _upto").select("_s", F.col("_b").alias("_cut"), (F.col("_part") - (F.col("_upto") - F.col("_t"))).alias("_left"))
    placed = one.join(steps, "_s").join(F.broadcast(cut), "_s", "left").drop("_part")
    inside = Window.partitionBy("_s").orderBy("_k", "_d").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where("_b = _cut").withColumn("_extra", (F.sum("_n").over(inside) - F.col("_n") / 2.0 <= F.col("_left")).cast("int"))
    rest = placed.where("_cut is null or _b <> _cut").withColumn("_extra", F.coalesce((F.col("_b") < F.col("_cut")).cast("int"), F.lit(0)))
    drawn = rest.unionByName(last).withColumn("repeats", F.col("_whole") + F.col("_extra")).where("repeats > 0")
    drawn = materialize(drawn.select("_d", "_s", "_name", "_n", "repeats"))
    got = drawn.groupBy("_s").agg(F.sum(F.col("_n") * F.col("repeats")).alias("_got"), F.sum("repeats").alias("_rows"))
    all_got = F.sum(F.coalesce("_got", F.lit(0))).over(Window.partitionBy(F.lit(0)))  # over one row a target
    report = table.join(F.broadcast(got), "_s", "left").select(
        F.col("_name").alias(source), F.col("_w").alias("target_share"), F.col("_r").alias("max_repeats"), F.col("_size").alias("tokens_available"),
        F.col("_aim").alias("tokens_aimed"), F.col("_e").alias("epochs"), F.coalesce("_got", F.lit(0)).alias("tokens_in_mix"),
        F.coalesce("_rows", F.lit(0)).alias("records_in_mix"), F.coalesce(F.try_divide(F.coalesce("_got", F.lit(0)), all_got), F.lit(0.0)).alias("share_reached"),
    )
    return drawn.select(F.col("_d").alias(doc), F.col("_name").alias(source), "repeats"), report
