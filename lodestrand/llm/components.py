"""Splits that keep related records together (problem 5).

Records and the entities they name form a graph. Random-mate contraction finds its components: in each round every
vertex flips a seeded coin, vertices that show tails collapse into a neighbour that shows heads, and edges are
relabelled, until none is left. The collapses are then unwound, last first, to give each vertex its component, and
components are laid out by cumulative weight to form the splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import materialize

#: A component is heavy if it weighs more than this part of all records; so there are at most this many of them.
HEAVY_COMPONENTS = 1_000
SLICES = 1_024
MAX_SPLITS = 1_000
MAX_ROUNDS = 400


def letters_and_number(name: str | Column) -> Column:
    """One spelling of an identifier: its letters in lower case and its number without leading zeros."""
    col = F.col(name) if isinstance(name, str) else name
    letters = F.regexp_replace(F.lower(col), r"[^\p{L}]+", "")
    number = F.regexp_replace(F.regexp_replace(col, r"[^0-9]+", ""), "^0+(?=[0-9])", "")
    return F.when(F.length(letters) + F.length(number) > 0, F.concat(letters, F.lit("#"), number))


def contract(edges: DataFrame, seed: int = 20260723) -> DataFrame:
    """(vertex, component) of every vertex of an undirected graph that isn't alone in its component's name.

    `edges` has string columns u and v. Loops, repeated edges and edges with a null end are ignored. A vertex that
    never collapses names its own component and is not listed. Which vertex names a component depends on the
    seed only. No edges: an empty result.

    An edge that is a component by itself needs no coin: it collapses in the first round that sees it. Each other round
    loses a quarter of the vertices on average. Both tables of a round, and each step of the unwinding, are written, so that plans stay
    short and a lost executor costs nothing.
    """
    live = materialize(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("the contraction did not end")

        def heads(end: str, turn: int = len(rounds)) -> Column:
            return F.xxhash64(F.lit(seed), F.lit(turn), F.col(end)).bitwiseAND(1) == 1

        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy(F.col("u").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"), F.min(F.when(~heads("u") & heads("v"), F.col("v"))).alias("h"))
        around = materialize(around)
        ends = around.where("n = 1")
        lone = ends.join(ends.select(F.col("t").alias("m"), F.col("m").alias("t")), ["t", "m"]).where("t < m")
        pairs = lone.select(F.explode(F.array(F.struct("t", F.col("m").alias("h")), F.struct(F.col("m").alias("t"), F.lit(None).cast("string").alias("h")))).alias("p")).select("p.t", F.col("p.h").alias("g"), F.lit(True).alias("alone"))
        mates = around.select("t", "h").join(pairs, "t", "left").select("t", F.when(F.col("alone"), F.col("g")).otherwise(F.col("h")).alias("h")).where("h is not null")
        mates = materialize(mates)
        rounds.append(mates)
        relabelled = (
            live.join(mates.select(F.col("t").alias("u"), F.col("h").alias("hu")), "u", "left")
            .select(F.coalesce("hu", "u").alias("u"), "v")
            .join(mates.select(F.col("t").alias("v"), F.col("h").alias("hv")), "v", "left")
            .select("u", F.coalesce("hv", "v").alias("v"))
        )
        live = materialize(
            relabelled.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        )
    if not rounds:
        return live.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    labels = rounds[-1].select(F.col("t").alias("vertex"), F.col("h").alias("component"))
    for mates in reversed(rounds[:-1]):
        known = labels.select(F.col("vertex").alias("h"), F.col("component").alias("_c"))
        labels = materialize(labels.unionByName(mates.join(known, "h", "left").select(F.col("t").alias("vertex"), F.coalesce("_c", "h").alias("component"))))
    return labels


def components(records: DataFrame, item: str, entities: dict[str, Callable[[str], Column]], seed: int = 20260723) -> DataFrame:
    """(item, component, linked): records that share an entity, directly or through others, share a component.

    `entities` gives for each column the function that brings its values to one spelling (null: names nothing); of a column of
    arrays every element is an entity, if the function gives an array.
    Records with a null item are left out; a record delivered twice counts once and has the entities of all its
    rows. A record that names no entity is a component of its own (linked false). Extra columns are ignored.

    Records that name the same entities are one vertex from the start, formed before anything is shuffled by
    entity, so that an entity shared by a third of all records has no more edges than any other.
    """
    found = records.select(F.col(item).alias("_i"), *[f(c).alias(f"_e{k}") for k, (c, f) in enumerate(entities.items())])

    def prefixed(k: int) -> Column:
        many = isinstance(found.schema[f"_e{k}"].dataType, T.ArrayType)
        each = F.col(f"_e{k}") if many else F.array(f"_e{k}")
        return F.coalesce(F.array_compact(F.transform(each, lambda e: F.concat(F.lit(f"e{k}:"), e))), F.array().cast("array<string>"))

    named = found.select("_i", F.concat(*map(prefixed, range(len(entities)))).alias("_e")).where("_i is not null")
    one = named.groupBy("_i").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_e")))).alias("_e"))
    one = one.withColumn("_v", F.when(F.size("_e") > 0, F.concat(F.lit("s:"), F.array_join("_e", "\u0001"))).otherwise(F.concat(F.lit("r:"), F.col("_i").cast("string"))))
    edges = one.where(F.size("_e") > 0).select("_v", "_e").dropDuplicates(["_v"]).select(F.col("_v").alias("u"), F.explode("_e").alias("v"))
    labels = contract(edges, seed).select(F.col("vertex").alias("_v"), F.col("component").alias("_c"))
    return one.join(labels, "_v", "left").select(
        F.col("_i").alias(item), F.coalesce("_c", "_v").alias("component"), (F.size("_e") > 0).alias("linked")
    )


def assign_splits(
    members: DataFrame, targets: DataFrame, split: str = "split_name", share: str = "target_share", seed: int = 20260723
) -> tuple[DataFrame, DataFrame]:
    """(members with a split, report): every component goes to one split, shares come close to the targets.

    Heavy components, at most HEAVY_COMPONENTS, go one by one, the heaviest first, to the split that lacks most.
    The others are lined up in a seeded order, and their cumulative weight against the room left in each split decides;
    the prefix sums are taken in SLICES slices, so no task holds all components. The report has target_share,
    records, share and components of each split. Shares are scaled to add up to 1; null or negative ones count as 0.
    Without members the result is empty and the report has zeros.
    """
    goals = [(g[0], max(0.0, g[1] or 0.0)) for g in targets.where(F.col(split).isNotNull()).select(split, F.col(share).cast("double")).orderBy(split).limit(MAX_SPLITS + 1).collect()]
    if not goals or len(goals) > MAX_SPLITS or sum(s for _, s in goals) <= 0:
        raise ValueError("targets need 1 to 1000 splits, one of them with a positive share")
    scale = sum(s for _, s in goals)
    spark = members.sparkSession
    weights = materialize(members.groupBy("component").agg(F.count(F.lit(1)).alias("_w")))
    total = weights.agg(F.sum("_w")).first()[0] or 0
    heavy = weights.where(F.col("_w") * HEAVY_COMPONENTS > total).orderBy(F.desc("_w"), "component").collect()
    room = {name: s / scale * total for name, s in goals}
    placed = []
    for c in heavy:
        name = max(room, key=lambda k: (room[k], k))
        room[name] -= c["_w"]
        placed.append((c["component"], name))
    # The light ones fill what is left of each split, in the order of the targets.
    left, ends, upto = {k: max(0.0, x) for k, x in room.items()}, [], 0.0
    light_total = total - sum(c["_w"] for c in heavy)
    for name in left:
        upto += left[name] / (sum(left.values()) or 1.0) * light_total
        ends.append((name, upto))
    light = weights.where(F.col("_w") * HEAVY_COMPONENTS <= total).withColumn("_k", F.xxhash64(F.lit(seed), "component"))
    light = light.withColumn("_s", F.shiftrightunsigned("_k", 54).cast("int"))
    slices = light.groupBy("_s").agg(F.sum("_w").alias("_sw"))  # at most SLICES rows
    before = slices.select("_s", (F.sum("_sw").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sw")).alias("_b"))
    inside = Window.partitionBy("_s").orderBy("_k", "component").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_b") + F.sum("_w").over(inside) - F.col("_w") / 2.0
    choice = F.lit(ends[-1][0])
    for name, end in reversed(ends[:-1]):
        choice = F.when(F.col("_m") < end, F.lit(name)).otherwise(choice)
    of_light = light.join(F.broadcast(before), "_s").select("component", middle.alias("_m")).select("component", choice.alias(split))
    of_heavy = F.broadcast(spark.createDataFrame(placed, f"component string, {split} string"))
    chosen = of_light.unionByName(of_heavy)
    assigned = members.join(of_heavy, "component").unionByName(members.join(of_heavy, "component", "left_anti").join(of_light, "component"))
    reached = weights.join(chosen, "component").groupBy(split).agg(F.sum("_w").alias("records"), F.count(F.lit(1)).alias("components"))
    report = spark.createDataFrame([(n, s / scale) for n, s in goals], f"{split} string, target_share double").join(reached, split, "left").select(
        split, "target_share", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / F.lit(float(max(1, total)))).alias("share"), F.coalesce("components", F.lit(0)).alias("components")
    )
    return assigned, report


def straddling(folds: DataFrame, members: DataFrame, batch: str, fold: str, ids: str, item: str) -> DataFrame:
    """Records in a test list whose component is, within the batch, in the test lists of more than one fold.

    Ids repeated in a list or in redelivered batches count once; null ids, ids without a record and records that name
    no entity are left out and make nothing.
    """
    tests = folds.select(F.col(batch).alias("_b"), F.col(fold).alias("_f"), F.explode(F.array_distinct(ids)).alias(item)).where(
        F.col(item).isNotNull() & F.col("_b").isNotNull() & F.col("_f").isNotNull()
    ).distinct()
    placed = tests.join(members.where("linked").select(item, "component"), item)
    spread = placed.groupBy("_b", "component").agg(F.min("_f").alias("_lo"), F.max("_f").alias("_hi")).where("_lo < _hi")
    return placed.join(spread.select("_b", "component"), ["_b", "component"], "left_semi").select(item).distinct()
