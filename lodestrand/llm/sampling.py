"""Sample matching target category proportions (problem 3).

Fractional quotas of a two-way table are made integers by a maximum flow that keeps both margins (controlled
rounding); each cell then gives exactly its quota of rows, those with the smallest seeded random keys.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import slug as spelled

#: The quota table is worked on in the driver; it comes from a table of targets, never from the records.
MAX_CELLS = 10_000
KEY_BITS = 12


def max_flow(edges: list[tuple[object, object, int]], source: object, sink: object) -> dict[tuple[object, object], int]:
    """A maximum flow by shortest augmenting paths; capacities are integers, parallel edges add up."""
    room: dict[object, dict[object, int]] = {}
    for a, b, capacity in edges:
        room.setdefault(a, {}).setdefault(b, 0)
        room[a][b] += capacity
        room.setdefault(b, {}).setdefault(a, 0)
    start = {a: dict(to) for a, to in room.items()}
    while source in room:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, left in room[a].items():
                if left > 0 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            break
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] += push
    return {(a, b): start[a][b] - left for a, to in room.items() for b, left in to.items() if start[a][b] > left}


def controlled_rounding(table: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """Integers for a two-way table: every cell, both margins and the total go to a neighbouring integer.

    Lower bounds are met by the usual extra source and sink; as the fractional table is itself a feasible flow,
    an integer one exists.
    """
    def bounds(x: float) -> tuple[int, int]:
        near = round(x)
        return (near, near) if abs(x - near) < 1e-9 else (math.floor(x), math.ceil(x))

    rows: dict[str, float] = {}
    cols: dict[str, float] = {}
    for (i, j), x in table.items():
        rows[i] = rows.get(i, 0.0) + x
        cols[j] = cols.get(j, 0.0) + x
    arcs = [("s", ("r", i), *bounds(x)) for i, x in rows.items()]
    arcs += [(("r", i), ("c", j), *bounds(x)) for (i, j), x in table.items()]
    arcs += [(("c", j), "t", *bounds(x)) for j, x in cols.items()]
    arcs += [("t", "s", *bounds(sum(rows.values())))]
    edges = [(a, b, high - low) for a, b, low, high in arcs]
    edges += [("S", b, low) for a, b, low, high in arcs if low] + [(a, "T", low) for a, b, low, high in arcs if low]
    flow = max_flow(edges, "S", "T")
    if sum(x for (a, _), x in flow.items() if a == "S") != sum(low for *_, low, _ in arcs):
        raise ValueError("no integer table keeps both margins")
    low = {(a, b): x for a, b, x, _ in arcs}
    return {(i, j): low[("r", i), ("c", j)] + flow.get((("r", i), ("c", j)), 0) for i, j in table}


def reachable(wanted: dict[tuple[str, str], int], available: dict[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    """How much of what each cell wants the records can give, as a maximum flow through rows, cells and columns."""
    rows: dict[str, int] = {}
    cols: dict[str, int] = {}
    for (i, j), n in wanted.items():
        rows[i] = rows.get(i, 0) + n
        cols[j] = cols.get(j, 0) + n
    edges = [("s", ("r", i), n) for i, n in rows.items()] + [(("c", j), "t", n) for j, n in cols.items()]
    edges += [(("r", i), ("c", j), min(n, available.get((i, j), 0))) for (i, j), n in wanted.items()]
    flow = max_flow(edges, "s", "t")
    return {(i, j): flow.get((("r", i), ("c", j)), 0) for i, j in wanted}


def _factor(weights: list[float], low: list[float], high: list[float], total: float) -> float:
    """The factor by which the weights, each then kept between its bounds, add up to `total` (or come as close as the bounds let)."""
    least, most = 0.0, max((h / w for w, h in zip(weights, high, strict=True) if w > 0), default=0.0)
    for _ in range(100):
        middle = (least + most) / 2
        if sum(_bounded(w * middle, x, h) for w, x, h in zip(weights, low, high, strict=True)) < total:
            least = middle
        else:
            most = middle
    return most


def _bounded(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


#: Rounds in which the table is fitted to its margins, alternately by rows and columns.
FITTING_ROUNDS = 500


def quotas(
    shares: dict[tuple[str, str], float], available: dict[tuple[str, str], int], floors: dict[tuple[str, str], int], size: int
) -> dict[tuple[str, str], int]:
    """Integer quotas between floor and what there is, whose margins are those of the shares as far as these bounds let.

    What a short cell lacks is made up in its row and its column, by bounded proportional fitting to the margins of the
    shares (a margin whose cells can't give it is cut, and the others take the rest by share). Where both
    margins can't be had at once the rows have theirs. Then the table is rounded.
    """
    cells = list(shares)
    cap = {c: float(available.get(c, 0)) for c in cells}
    base = {c: float(min(floors.get(c, 0), cap[c])) for c in cells}
    total = min(float(size), sum(cap.values()))
    lines = [{name: [c for c in cells if c[k] == name] for name in dict.fromkeys(c[k] for c in cells)} for k in (0, 1)]
    margins, factors = [], [dict.fromkeys(group, 1.0) for group in lines]
    for group in lines:
        sums = {n: [sum(of[c] for c in g) for of in (shares, base, cap)] for n, g in group.items()}
        f = _factor(*map(list, zip(*sums.values(), strict=True)), total)
        margins.append({n: _bounded(w * f, x, h) for n, (w, x, h) in sums.items()})

    def value(c: tuple[str, str]) -> float:
        return _bounded(shares[c] * factors[0][c[0]] * factors[1][c[1]], base[c], cap[c])

    table: dict[tuple[str, str], float] = {}
    for _ in range(FITTING_ROUNDS):
        for k in (1, 0):
            for name, g in lines[k].items():
                weights = [shares[c] * factors[1 - k][c[1 - k]] for c in g]
                factors[k][name] = _factor(weights, [base[c] for c in g], [cap[c] for c in g], margins[k][name])
        before, table = table, {c: value(c) for c in cells}
        if before and all(abs(table[c] - before[c]) < 1e-9 for c in cells):
            break
    return controlled_rounding(table)


def controlled_sample(
    records: DataFrame,
    targets: DataFrame,
    item: str,
    row: str,
    col: str,
    share: str = "target_share",
    rows_wanted: str = "target_rows",
    floor: str = "min_rows",
    seed: int = 20260723,
) -> tuple[DataFrame, DataFrame]:
    """A sample whose cells (row x col) have the shares of `targets`, and a report with one row per cell.

    Returns (sample, report). The sample has (item, row, col), categories spelled as in the targets. Its size is
    the sum of rows_wanted, or all records of the target cells if they are fewer. The report has for each cell available,
    wanted (the greater of rows_wanted and floor), reachable (how much of that the flow can give), quota, short (reachable
    below wanted), the target and reached share of the cell, and those of its row and its column.

    Categories match however they are spelled. Records with a null id or category, or of no target cell, are
    left out; a record delivered twice, or with two cells, counts once (in its first cell in order). Null shares and row
    counts of targets count as 0, target cells given twice add up. An empty table of records gives quotas of 0;
    an empty table of targets gives an empty sample and report. Extra columns are ignored.
    """
    goals = (
        targets.select(
            spelled(row).alias("_r"), spelled(col).alias("_c"), F.col(row).alias("_rs"), F.col(col).alias("_cs"),
            *[F.coalesce(F.col(c).cast(kind), F.lit(0)).alias(n) for c, kind, n in ((share, "double", "_s"), (rows_wanted, "bigint", "_w"), (floor, "bigint", "_f"))],
        )
        .where("_r is not null and _c is not null")
        .groupBy("_r", "_c")
        .agg(F.min("_rs").alias("_rs"), F.min("_cs").alias("_cs"), F.sum("_s").alias("_s"), F.sum("_w").alias("_w"), F.sum("_f").alias("_f"))
    )
    cells = {(g["_r"], g["_c"]): g for g in goals.limit(MAX_CELLS + 1).collect()}
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    spark = records.sparkSession

    known = F.broadcast(spark.createDataFrame([(r, c) for r, c in cells], "_r string, _c string"))
    key = F.xxhash64(F.lit(seed), F.col("_i"))
    one = (
        records.select(F.col(item).alias("_i"), spelled(row).alias("_r"), spelled(col).alias("_c"))
        .where("_i is not null and _r is not null and _c is not null")
        .join(known, ["_r", "_c"])
        .groupBy("_i")
        .agg(F.min(F.struct("_r", "_c")).alias("_cell"))
        .select("_i", "_cell._r", "_cell._c", key.alias("_k"))
        .withColumn("_b", F.shiftrightunsigned("_k", 64 - KEY_BITS).cast("int"))
    )
    buckets = one.groupBy("_r", "_c", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upward = Window.partitionBy("_r", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.select("_r", "_c", "_b", "_n", F.sum("_n").over(upward).alias("_upto"))
    # At most 2**KEY_BITS rows a target cell, whatever the number of records.
    counted = buckets.groupBy("_r", "_c").agg(F.max("_upto").alias("_n"))
    available = {(x["_r"], x["_c"]): x["_n"] for x in counted.collect()}
    shares, floors = {c: g["_s"] for c, g in cells.items()}, {c: g["_f"] for c, g in cells.items()}
    wanted = {c: max(g["_w"], g["_f"]) for c, g in cells.items()}
    can = reachable(wanted, available)
    quota = quotas(shares, available, floors, sum(g["_w"] for g in cells.values())) if cells else {}

    def part(of: dict[tuple[str, str], float], c: tuple[str, str], k: int | None = None) -> float:
        """The share of a cell, or of its row (k = 0) or column (k = 1), in all."""
        mine = of[c] if k is None else sum(x for d, x in of.items() if d[k] == c[k])
        return float(mine) / (float(sum(of.values())) or 1.0)

    drawn_shares = [f"{kind}_{what}_share double" for what in ("target", "reached") for kind in ("cell", "row", "column")]
    table = spark.createDataFrame(
        [
            (*c, g["_rs"], g["_cs"], available.get(c, 0), wanted[c], can[c], quota[c], *[part(of, c, k) for of in (shares, quota) for k in (None, 0, 1)])
            for c, g in cells.items()
        ],
        "_r string, _c string, _rs string, _cs string, available bigint, wanted bigint, reachable bigint, quota bigint, " + ", ".join(drawn_shares),
    )
    report = table.select(
        F.col("_rs").alias(row), F.col("_cs").alias(col), "available", "wanted", "reachable", "quota", (F.col("reachable") < F.col("wanted")).alias("short"),
        *[d.split()[0] for d in drawn_shares],
    )
    # The bucket in which a cell's quota is reached: buckets below are taken whole, of this one the smallest keys.
    cut = (
        buckets.join(F.broadcast(table.select("_r", "_c", "quota", "_rs", "_cs")), ["_r", "_c"])
        .where("_upto >= quota and _upto - _n < quota")
        .select("_r", "_c", "_rs", "_cs", F.col("_b").alias("_cut"), (F.col("quota") - (F.col("_upto") - F.col("_n"))).alias("_left"))
    )
    drawn = one.join(F.broadcast(cut), ["_r", "_c"]).where("_b <= _cut")
    place = F.row_number().over(Window.partitionBy("_r", "_c").orderBy("_k", "_i"))
    last = drawn.where("_b = _cut").withColumn("_p", place).where("_p <= _left").drop("_p")
    sample = drawn.where("_b < _cut").unionByName(last)
    return sample.select(F.col("_i").alias(item), F.col("_rs").alias(row), F.col("_cs").alias(col)), report
