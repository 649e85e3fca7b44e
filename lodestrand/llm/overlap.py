"""Same or near-same records across splits (problem 2).

Edit-distance segment join: a pair of texts whose similarity reaches the threshold is at most k insertions and deletions
apart. Evaluation texts are cut into more than k segments, so some segments recur unharmed in the training text, at a
position that k edits allow. Pairs with too few such segments, or with more characters to change than k, are dropped, the
rest verified by dynamic programming in a band of k+1 diagonals, and the few that pass get their exact similarity.

At 0.85 a segment has about three characters, and texts of one language share some with nearly every other (37 of 100 pairs of English
questions share enough of them). A join of segments on their own would make more rows than there are pairs, so the segments of
a block of texts are met with the substrings of another in arrays. Blocks are ranges of length, of which only those meet whose lengths
allow the threshold.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import normalize_text
from lodestrand.session import materialize, ship_package

#: Questions of one batch that one task holds on either side at most; larger batches are worked on in blocks of this size.
BLOCK = 2_048
CHUNK = 512
#: Classes of characters that are counted for each text.
CLASSES = 64
PAIR = T.StructType(
    [
        T.StructField("batch", T.StringType()), T.StructField("evaluated", T.StringType()), T.StructField("trained", T.StringType()),
        T.StructField("folds", T.ArrayType(T.StringType())), T.StructField("similarity", T.DoubleType()),
    ]
)


def comparable(text: str) -> str:
    """A text as it is compared: compatibility forms and case folded, only letters, digits and underscores kept."""
    return normalize_text(text, "question")


def edits(a: np.ndarray | int, b: np.ndarray | int, threshold: float):
    """The insertions and deletions between texts of these lengths whose similarity reaches the threshold, at most."""
    return np.floor((1.0 - threshold) * (a + b) + 1e-9).astype(int)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows, padded by -1, and the lengths."""
    lengths = np.array([len(t) for t in texts], dtype=int)
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), -1, dtype=np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
    return out, lengths


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for each substring of `width` characters (equal substrings, equal numbers)."""
    n = codes.shape[1] - width + 1
    h = np.full((codes.shape[0], max(0, n)), width, dtype=np.int64)
    for w in range(width):
        h = h * np.int64(1_000_003) + codes[:, w : w + n] + 2
    return h


def _counted(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many characters of each class a text has."""
    rows = np.repeat(np.arange(len(codes)), lengths)
    values = codes[np.arange(codes.shape[1])[None, :] < lengths[:, None]].astype(np.int64)
    return np.bincount(rows * CLASSES + values * 40_503 // 64 % CLASSES, minlength=len(codes) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def candidates(left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) that can reach the threshold, by the segments they share; same: both sides are the same, each pair once.

    Each left text of n characters is cut into m segments, one more than the edits its longest partner allows. Of two
    texts k edits apart at least m - k segments survive, each shifted by no more than k edits on its two sides can do.
    """
    longest = np.floor(left_n * (2 - threshold) / threshold + 1e-9).astype(int)
    pieces = np.minimum(np.maximum(left_n, 1), edits(left_n, longest, threshold) + 1)
    seg_text, seg_at, seg_no, seg_hash, widths = [], [], [], [], set()
    for width in range(1, int(np.ceil(np.max(left_n / pieces, initial=1))) + 1):
        h = _hashes(left, width)
        for i in range(len(left)):
            cuts = (np.arange(pieces[i] + 1) * left_n[i]) // pieces[i]
            mine = np.flatnonzero(np.diff(cuts) == width)
            if len(mine):
                widths.add(width)
                seg_text.append(np.full(len(mine), i))
                seg_at.append(cuts[mine])
                seg_no.append(mine)
                seg_hash.append(h[i, cuts[mine]])
    if not seg_text:
        return np.empty(0, int), np.empty(0, int)
    s_text, s_at, s_no, s_hash = map(np.concatenate, (seg_text, seg_at, seg_no, seg_hash))
    order = np.argsort(s_hash, kind="stable")
    s_text, s_at, s_no, s_hash = s_text[order], s_at[order], s_no[order], s_hash[order]
    most = int(pieces.max()) + 1
    found = []
    for width in sorted(widths):
        h = _hashes(right, width)
        for begin in range(0, len(right), 64):
            part = h[begin : begin + 64]
            inside = np.arange(part.shape[1])[None, :] + width <= right_n[begin : begin + 64, None]
            r_text, r_at = np.nonzero(inside)
            r_hash = part[r_text, r_at]
            lo, hi = np.searchsorted(s_hash, r_hash, "left"), np.searchsorted(s_hash, r_hash, "right")
            n = hi - lo
            r_text, r_at = np.repeat(r_text + begin, n), np.repeat(r_at, n)
            seg = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            a, shift = s_text[seg], r_at - s_at[seg]
            gap = right_n[r_text] - left_n[a]
            near = np.abs(shift) + np.abs(gap - shift) <= edits(left_n[a], right_n[r_text], threshold)
            if same:
                near &= a < r_text
            found.append(np.unique((a[near] * len(right) + r_text[near]) * most + s_no[seg[near]]))
    pairs, shared = np.unique(np.unique(np.concatenate(found)) // most, return_counts=True)
    a, b = pairs // len(right), pairs % len(right)
    enough = shared >= pieces[a] - edits(left_n[a], right_n[b], threshold)
    return a[enough], b[enough]


def verify(left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each left text and the right text beside it are within the edits that the threshold allows.

    Row by row the longest common subsequence is found in the band of diagonals that so many edits can reach, for
    all pairs at once; every few rows pairs are given up that can't make it any more.
    """
    result = np.zeros(len(left), dtype=bool)
    k = edits(left_n, right_n, threshold)
    gap = right_n - left_n
    alive = np.flatnonzero(np.abs(gap) <= k)
    if not len(alive):
        return result
    low, high = int(np.min((gap - k)[alive] // 2)), int(np.max(-((-gap - k)[alive] // 2)))
    width, rows = high - low + 1, int(left_n[alive].max())
    pad = np.full((len(left), rows + right.shape[1] + 2 * width + abs(low) + 2), -2, dtype=np.int32)
    pad[:, max(0, -low) : max(0, -low) + right.shape[1]] = right
    start = max(0, -low) + low
    goal = -((-(left_n + right_n - k)) // 2)
    need, a, b, an, bn, ids = goal[alive], left[alive], pad[alive], left_n[alive], right_n[alive], alive
    best = np.zeros((len(alive), width + 1), dtype=np.int16 if rows <= np.iinfo(np.int16).max else np.int32)
    diagonals = np.arange(low, high + 1)
    for i in range(rows):
        over = i >= an
        step = np.maximum(best[:, :-1] + (b[:, start + i : start + i + width] == a[:, i : i + 1]), best[:, 1:])
        step = np.maximum.accumulate(step, axis=1)
        best[:, :-1] = np.where(over[:, None], best[:, :-1], step)
        best[:, -1] = best[:, -2] * 0
        if i % 12 == 11 or i == rows - 1:
            at = np.minimum(i + 1, an)[:, None]
            room = np.minimum(an[:, None] - at, np.maximum(0, bn[:, None] - at - diagonals[None, :]))
            reach = (best[:, :-1] + room).max(axis=1)
            keep = reach >= need
            if not keep.all():
                need, a, b, an, bn, ids, best = need[keep], a[keep], b[keep], an[keep], bn[keep], ids[keep], best[keep]
                if not len(ids):
                    return result
    result[ids] = best[:, :-1].max(axis=1) >= need
    return result


def close_pairs(lefts: list[str], rights: list[str] | None, threshold: float, wanted=None) -> list[tuple[int, int]]:
    """Index pairs of different texts, within the edits that the threshold allows; without `rights` pairs of `lefts`, each once.

    Texts of a side are all different and none is empty. wanted: given two arrays of indexes, which pairs are looked at.
    """
    same = rights is None
    if not lefts or not (same or rights):
        return []
    x, xn = _codes(lefts)
    y, yn = (x, xn) if same else _codes(rights)
    a, b = candidates(x, xn, y, yn, threshold, same)
    if wanted is not None:
        keep = wanted(a, b)
        a, b = a[keep], b[keep]
    xc = _counted(x, xn)
    yc = xc if same else _counted(y, yn)
    others = lefts if same else rights
    kept = [np.empty((0, 2), dtype=int)]
    for begin in range(0, len(a), 8 * CHUNK):
        i, j = a[begin : begin + 8 * CHUNK], b[begin : begin + 8 * CHUNK]
        fits = np.abs(xc[i] - yc[j]).sum(axis=1) <= edits(xn[i], yn[j], threshold)
        kept.append(np.column_stack((i[fits], j[fits])))
    a, b = np.concatenate(kept).T
    order = np.lexsort((yn[b], xn[a]))
    a, b = a[order], b[order]
    out = []
    for begin in range(0, len(a), CHUNK):
        i, j = a[begin : begin + CHUNK], b[begin : begin + CHUNK]
        found = verify(x[i, : xn[i].max()], xn[i], y[j, : yn[j].max()], yn[j], threshold)
        out += [(int(i[p]), int(j[p])) for p in np.flatnonzero(found) if lefts[i[p]] != others[j[p]]]
    return out


def ratio_from(s: str, t: str, threshold: float) -> float | None:
    """The ratio of matching blocks of two texts if it reaches the threshold."""
    if s == t:
        return 1.0
    matcher = SequenceMatcher(None, s, t)
    if matcher.real_quick_ratio() < threshold or matcher.quick_ratio() < threshold:
        return None
    return ratio if (ratio := matcher.ratio()) >= threshold else None


def similar_pairs(left: list[str], right: list[str], threshold: float) -> list[tuple[int, int, float]]:
    """(left, right, similarity) of all pairs of non-empty texts that reach the threshold; a copy is compared once, equal texts never."""
    where: list[dict[str, list[int]]] = [{}, {}]
    for of, texts in zip(where, (left, right), strict=True):
        for i, t in enumerate(texts):
            if t:
                of.setdefault(t, []).append(i)
    lefts, rights = sorted(where[0]), sorted(where[1])
    pairs = [(t, t) for t in lefts if t in where[1]] + [(lefts[i], rights[j]) for i, j in close_pairs(lefts, rights, threshold)]
    return [(u, v, ratio) for s, t in pairs if (ratio := ratio_from(s, t, threshold)) is not None for u in where[0][s] for v in where[1][t]]


def _roles(pdf: pd.DataFrame, texts: dict[str, int], folds: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each different text the folds in which a record with it is evaluated, and those in which one is trained on."""
    out = np.zeros((2, len(texts), len(folds)), dtype=bool)
    for t, tests, trains in zip(pdf["_t"], pdf["_test"], pdf["_train"], strict=True):
        out[0, texts[t], [folds[f] for f in tests]] = True
        out[1, texts[t], [folds[f] for f in trains]] = True
    return out[0], out[1]


def _in_group(threshold: float):
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["_i"].iat[0] == pdf["_j"].iat[0]
        sides = [pdf] if one else [pdf[pdf["_own"] == pdf["_i"]], pdf[pdf["_own"] == pdf["_j"]]]
        folds = {f: k for k, f in enumerate(dict.fromkeys(f for c in ("_test", "_train") for fs in pdf[c] for f in fs))}
        lists = [sorted(set(side["_t"])) for side in sides]
        numbers = [{t: k for k, t in enumerate(texts)} for texts in lists]
        roles = [_roles(side, of, folds) for side, of in zip(sides, numbers, strict=True)]
        (lt, lr), (rt, rr) = roles[0], roles[-1]

        def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(a), dtype=bool)
            for f in range(len(folds)):
                keep |= (lt[a, f] & rr[b, f]) | (lr[a, f] & rt[b, f])
            return keep

        records: list[dict[str, list]] = []
        for side in sides:
            of: dict[str, list] = {}
            for q, t, tests, trains in zip(side["_q"], side["_t"], side["_test"], side["_train"], strict=True):
                of.setdefault(t, []).append((q, set(tests), set(trains)))
            records.append(of)
        first, second = records[0], records[-1]
        texts = [(lists[0][i], lists[-1][j]) for i, j in close_pairs(lists[0], None if one else lists[1], threshold, wanted)]
        rows = []
        for s, t in [(t, t) for t in first if t in second] + texts:
            ratios: dict[bool, float | None] = {}
            for q, q_tests, q_trains in first[s]:
                for r, r_tests, r_trains in second[t]:
                    if q == r or (one and s == t and q > r):
                        continue
                    for forward, both in ((True, q_tests & r_trains), (False, r_tests & q_trains)):
                        if both:
                            if forward not in ratios:
                                ratios[forward] = ratio_from(s, t, threshold) if forward else ratio_from(t, s, threshold)
                            if ratios[forward] is not None:
                                rows.append((pdf["_b"].iat[0], *((q, r) if forward else (r, q)), sorted(both), ratios[forward]))
        return pd.DataFrame(rows, columns=PAIR.names)

    return join


def cross_split_overlaps(
    folds: DataFrame, questions: DataFrame, batch: str = "batch_id", fold: str = "outer_test_fold", train: str = "train_question_ids",
    test: str = "test_question_ids", item: str = "question_id", text: str = "query_text", threshold: float = 0.85, block: int = BLOCK,
) -> DataFrame:
    """(batch, evaluated, trained, folds, similarity): each evaluation record that a training record of its batch and fold matches.

    `folds` lists the folds, as text, in which one is evaluated and the other trained on; a null fold is a fold of its own, written as an
    empty text. Similarity is the ratio of matching blocks of the comparable texts, the evaluated text first. Null texts, and those
    empty once comparable, never match; ids without a record, null ids and batches, ids repeated in lists and rows delivered
    twice make no further pairs; of two texts of one id the first in order counts. Extra columns are ignored.

    A batch of more than `block` records is cut into ranges of length of about that size, and worked on in pairs of those whose
    lengths allow the threshold, so that no task holds more than two of them.
    """
    if not 0.5 < threshold <= 1.0:
        raise ValueError("threshold must be above 0.5 and at most 1")
    spark = folds.sparkSession
    ship_package(spark)
    listed = None
    for column, name in ((test, "_test"), (train, "_train")):
        other = "_train" if name == "_test" else "_test"
        rows = folds.select(
            F.col(batch).cast("string").alias("_b"), F.coalesce(F.col(fold).cast("string"), F.lit("")).alias(name), F.lit(None).cast("string").alias(other),
            F.explode(F.array_distinct(F.col(column).cast("array<string>"))).alias("_q"),
        ).where("_b is not null and _q is not null")
        listed = rows if listed is None else listed.unionByName(rows)
    members = listed.groupBy("_b", "_q").agg(F.collect_set("_test").alias("_test"), F.collect_set("_train").alias("_train"))

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else comparable(t) for t in texts], dtype=object)

    texts = questions.where(F.col(item).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(item).cast("string").alias("_q")).agg(F.min(text).alias("_t"))
    texts = texts.select("_q", clean("_t").alias("_t")).where("length(_t) > 0").withColumn("_l", F.length("_t"))
    there = materialize(members.join(texts, "_q"))
    # Ranges of length: one row a batch and length, so that no batch is sorted as a whole.
    lengths = there.groupBy("_b", "_l").agg(F.count(F.lit(1)).alias("_n"))
    shorter = F.sum("_n").over(Window.partitionBy("_b").orderBy("_l").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ranges = lengths.select("_b", "_l", "_n", shorter.alias("_s"))
    place = F.floor((F.col("_s") + F.pmod(F.xxhash64("_q"), F.col("_n"))) / block).cast("int")
    placed = there.join(ranges, ["_b", "_l"]).withColumn("_own", place)
    first = ranges.select("_b", "_l", F.floor(F.col("_s") / block).cast("int").alias("_f"), F.floor((F.col("_s") + F.col("_n") - 1) / block).cast("int").alias("_g"))
    blocks = first.select("_b", "_l", F.explode(F.sequence("_f", "_g")).alias("_own")).groupBy("_b", "_own").agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"))
    later = blocks.select("_b", F.col("_own").alias("_j"), F.col("_lo").alias("_from"))
    meets = (F.col("_own") <= F.col("_j")) & (F.col("_from") * threshold <= F.col("_hi") * (2 - threshold))
    pairs = blocks.join(later, "_b").where(meets).select("_b", F.col("_own").alias("_i"), "_j")
    each = pairs.select("_b", "_i", "_j", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_own"))
    spread = placed.join(each, ["_b", "_own"]).select("_b", "_i", "_j", "_own", "_q", "_t", "_test", "_train")
    # Blocks take long for their size, so they are spread by number and not put together by size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return spread.repartition(tasks, "_b", "_i", "_j").groupBy("_b", "_i", "_j").applyInPandas(_in_group(threshold), PAIR)
