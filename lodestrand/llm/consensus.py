"""Consensus from several annotators' labels (problem 4).

Iteratively reweighted voting: a weighted vote gives each item a consensus, and the agreement of each annotator with
the consensus of the others (leave-one-out, smoothed) gives the weights of the next vote, until they are stable. The
accuracy is kept per label: how often an annotator gives label x where the others settle on y. An annotator who always
mixes up two labels, or always gives the same one, has a low plain accuracy, but tells much or nothing by label.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import slug as spelled
from lodestrand.session import materialize

#: Weights of all annotators travel with each task: 25 numbers an annotator for five labels.
MAX_ANNOTATORS = 2_000


def valid_votes(
    df: DataFrame, item: tuple[str, ...], annotator: str, label: str, role: str, at: str, labels: tuple[str, ...],
    tie: str, reason: str | None = None,
) -> DataFrame:
    """One row for each item, annotator and role group: (_item, _a, _settles, _x, _why) with the label that stands.

    Only the given labels count, however label, annotator and role are spelled; of several labels of one annotator for
    an item the latest stands (then the greatest `tie`). Rows lacking part of the item, annotator or time are left out.
    """
    code = spelled(label)
    index = F.lit(None).cast("int")
    for k, name in enumerate(labels):
        index = F.when(code == name.lower(), F.lit(k)).otherwise(index)
    rows = df.select(
        F.struct(*[F.col(c).alias(c) for c in item]).alias("_item"),
        F.upper(spelled(annotator)).alias("_a"),
        (spelled(role) == "adjudicated").alias("_settles"),
        index.alias("_x"),
        F.col(at).alias("_at"),
        F.col(tie).alias("_tie"),
        (F.col(reason) if reason else F.lit(None).cast("string")).alias("_why"),
    ).where("_x is not null and _at is not null and _settles is not null and length(_a) > 0")
    for c in item:
        rows = rows.where(F.col(f"_item.{c}").isNotNull())
    last = rows.groupBy("_item", "_a", "_settles").agg(F.max(F.struct("_at", "_tie", "_x", "_why")).alias("_l"))
    return last.select("_item", "_a", "_settles", F.col("_l._x").alias("_x"), F.col("_l._why").alias("_why"), F.col("_l._at").alias("_at"))


class Voting:
    """Items with their votes, and the weights that the iterations reach."""

    def __init__(self, votes: DataFrame, k: int, anchored: bool = False, smoothing: float = 5.0, rounds: int = 200, stable: float = 1e-3):
        """`votes` as from valid_votes. anchored: a settling label is the consensus of its item wherever there is one.

        Votes are gathered by item once. Items with the same votes are one pattern with a count, and the rounds read patterns
        only, of which there are far fewer than items as soon as items outnumber the ways in which a few annotators can vote.
        `converged` tells whether the weights were stable within `rounds`; it comes out with the reliability.
        """
        settled = F.max_by(F.when(F.col("_settles"), F.col("_x")), F.when(F.col("_settles"), F.struct("_at", "_a")))
        self.items = materialize(
            votes.groupBy("_item").agg(
                F.array_sort(F.collect_list(F.when(~F.col("_settles"), F.struct("_a", "_x", "_why")))).alias("_v"),
                (settled if anchored else F.lit(None).cast("int")).alias("_gold"),
            )
        )
        plain = F.transform("_v", lambda v: F.struct(v["_a"].alias("_a"), v["_x"].alias("_x")))
        patterns = materialize(self.items.where(F.size("_v") > 0).groupBy(plain.alias("_v"), "_gold").agg(F.count(F.lit(1)).alias("_n")))
        names = patterns.select(F.explode("_v._a").alias("_a")).distinct().orderBy("_a").limit(MAX_ANNOTATORS + 1).collect()
        if len(names) > MAX_ANNOTATORS:
            raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
        self.k, self.names = k, [r["_a"] for r in names]
        self.patterns = materialize(patterns.select(self._numbered(), "_gold", "_n"))
        self.prior = [math.log(1.0 / k)] * k
        start = [math.log(0.7) if x == y else math.log(0.3 / max(1, k - 1)) for x in range(k) for y in range(k)]
        self.weights = start * len(self.names)
        self.counts: dict[tuple[int, int, int], int] = {}
        self.iterations, self.converged = 0, not self.names
        while self.iterations < rounds and not self.converged:
            self.converged = self._iterate(smoothing) < stable
            self.iterations += 1

    def _numbered(self) -> Column:
        """The votes with the numbers of their annotators in place of the codes."""
        known = F.array(*[F.lit(n) for n in self.names]) if self.names else F.array().cast("array<string>")
        return F.transform("_v", lambda v: F.struct((F.array_position(known, v["_a"]).cast("int") - 1).alias("_j"), v["_x"].alias("_x"))).alias("_v")

    def _place(self, y: str | int) -> str:
        """Where the weight of a vote v for label y is."""
        return f"(v._j * {self.k} + v._x) * {self.k} + {y}"

    def _scored(self, df: DataFrame) -> DataFrame:
        """`df` with _weights, one constant folded once, and _s, the log score of each label for the votes of a row."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        totals = [f"aggregate(_v, {self.prior[y]!r}D, (s, v) -> s + _weights[{self._place(y)}])" for y in range(self.k)]
        return df.withColumn("_weights", weights).withColumn("_s", F.expr(f"array({', '.join(totals)})"))

    def _iterate(self, smoothing: float) -> float:
        """One round; how far a weight moved at most. Only counts by annotator and two labels reach the driver."""
        k = self.k
        voting = self.patterns.where("size(_v) > 1 or _gold is not null")
        rest = f"transform(sequence(0, {k - 1}), y -> _s[y] - _weights[{self._place('y')}])"  # the scores without the vote itself
        seen = self._scored(voting).select("_n", "_gold", F.expr(f"explode(transform(_v, v -> struct(v._j as j, v._x as x, {rest} as t)))").alias("o"))
        first = F.expr("coalesce(_gold, cast(array_position(o.t, array_max(o.t)) - 1 as int))").alias("y")
        counts = seen.select("_n", "o.j", "o.x", first).groupBy("j", "x", "y").agg(F.sum("_n").alias("n"))
        self.counts = {(r["j"], r["x"], r["y"]): r["n"] for r in counts.collect()}
        of = lambda j, x, y: self.counts.get((j, x, y), 0)
        per_y = [sum(n for (_, _, b), n in self.counts.items() if b == y) for y in range(k)]
        total = sum(per_y)
        self.prior = [math.log((n + 1.0) / (total + k)) for n in per_y]
        fresh = []
        for j in range(len(self.names)):
            given = [sum(of(j, x, y) for x in range(k)) for y in range(k)]
            # An annotator's plain accuracy fills in where a label is rare.
            right, n = sum(of(j, y, y) for y in range(k)), sum(given)
            plain = (right + 0.5 * smoothing) / (n + smoothing)
            for x in range(k):
                for y in range(k):
                    base = plain if x == y else (1 - plain) / max(1, k - 1)
                    fresh.append(math.log((of(j, x, y) + smoothing * max(base, 1e-3)) / (given[y] + smoothing)))
        moved = max((abs(a - b) for a, b in zip(fresh, self.weights, strict=True)), default=0.0)
        self.weights = fresh
        return moved

    def consensus(self, least: int = 2) -> DataFrame:
        """(_item, _v, _y, _margin): the consensus of each item with `least` or more votes.

        Where the vote is anchored a settled item has its settled label and an infinite margin; else the margin is the log score by which the first
        label beats the second. Equal scores go to the first of the labels.
        """
        numbered = self.items.where(F.size("_v") >= least).select("_item", F.col("_v").alias("_w"), "_gold", self._numbered())
        scored = self._scored(numbered)
        ordered = F.sort_array("_s", asc=False)
        margin = F.when(F.col("_gold").isNotNull(), F.lit(float("inf"))).otherwise(ordered[0] - ordered[1] if self.k > 1 else F.lit(0.0))
        first = F.expr("coalesce(_gold, cast(array_position(_s, array_max(_s)) - 1 as int))").alias("_y")
        return scored.select("_item", F.col("_w").alias("_v"), first, margin.alias("_margin"))

    def reliability(self) -> list[tuple[str, int, float, float, int, bool]]:
        """(annotator, votes held against others, plain accuracy, informativeness in bits, rounds, converged) of each annotator."""
        out = []
        for j, name in enumerate(self.names):
            table = [[self.counts.get((j, x, y), 0) for y in range(self.k)] for x in range(self.k)]
            n = sum(map(sum, table))
            right = sum(table[y][y] for y in range(self.k))
            rows, cols = [sum(r) for r in table], [sum(r[y] for r in table) for y in range(self.k)]
            bits = sum(c / n * math.log2(c * n / (rows[x] * cols[y])) for x, r in enumerate(table) for y, c in enumerate(r) if c) if n else 0.0
            out.append((name, n, (right + 1.0) / (n + 2.0), bits, self.iterations, self.converged))
        return out


def krippendorff(votes: DataFrame, k: int) -> DataFrame:
    """One row (items, ratings, observed, expected, alpha): nominal alpha, which allows for missing ratings.

    Items with one vote are left out. No disagreement expected (all ratings the same, or none): alpha is null.
    """
    counts = votes.where("not _settles").groupBy("_item").agg(
        F.count(F.lit(1)).alias("_m"), *[F.count_if(F.col("_x") == x).alias(f"_c{x}") for x in range(k)]
    ).where("_m > 1")
    same = sum((F.col(f"_c{x}") * (F.col(f"_c{x}") - 1) for x in range(k)), F.lit(0))
    sums = counts.agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("_m"), F.lit(0)).alias("ratings"),
        F.sum((F.col("_m") * (F.col("_m") - 1) - same) / (F.col("_m") - 1)).alias("_d"), *[F.sum(f"_c{x}").alias(f"_n{x}") for x in range(k)]
    )
    n = F.col("ratings").cast("double")
    squares = sum((F.col(f"_n{x}").cast("double") * F.col(f"_n{x}") for x in range(k)), F.lit(0.0))
    both = sums.select("items", "ratings", F.try_divide("_d", n).alias("observed"), F.try_divide(n * n - squares, n * (n - 1)).alias("expected"))
    return both.select("items", "ratings", "observed", "expected", (1 - F.try_divide("observed", "expected")).alias("alpha"))
