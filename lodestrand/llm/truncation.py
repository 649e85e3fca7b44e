"""Text cut off by field limits (problem 9).

Near-copies are found by min-hash banding of the heads of texts, verified and aligned: the copy whose alignment ends early, within a
sentence or word of the longer one, was cut. Records without such a copy are scored by how they close: what the whole corpus tells
about the same closing words, whether lines end there or go on, and about lines of the same kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import materialize, ship_package

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 4
#: Of each of the BANDS x ROWS minima two bits are kept. Heads of the similarity wanted agree in 27 of 32 on average, give or
#: take 2.0; pairs that agree in fewer than these, three times that spread below, are not looked at closer.
AGREEING = 21
#: Words of the shortest head; the others are twice, four times ... as long.
HEAD = 5
#: Words of the end of a text that are aligned, and that the ends of its copy may be shifted by.
TAIL = 64
#: Closing words, from the most that are seen often enough; three ideographs count as a word. A number alone is no closing word.
LEVELS = (6, 4, 2, 1)
SUPPORT = 4
TERMINAL = 0.1
#: Characters of a line's opening; openings, and kinds of lines, of which so few lines end without a sign are those of prose, and
#: openings of which nearly all lines are the last of their text are those of closing lines.
OPENING = 4
PROSE, CLOSER = 0.2, 0.9
CERTAIN = 0.5
#: Bits for each key that is asked for in the map that travels with the tasks, and its size in bits at least and at most. Beyond that
#: the map only lets more through that nobody asked for.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 16, 26

WORD = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]|[^\W\u3400-\u4dbf\u4e00-\u9fff]+")
SENTENCE_END = re.compile("[\u3002\uff1f\uff01.?!][\u201d\u2019\"')\\]\uff09\u300b\u3011]*$")
NUMBER_DOT = re.compile(r"[0-9]\.$")
INNER_END = re.compile("[\u3002\uff1f\uff01][\u201d\"]?(?=[^\u201d\"\\s])|(?<=[^\\W_][^\\W_\\d])[.?!][\u201d\"]? +(?=[^\\W\\d_a-z]|[\"\u201c\u2018])|(?<=\\d)[.?!][\u201d\"]? +(?=[A-Z\"\u201c])")
TAGS = re.compile(r"(\s*</\w[\w:.-]*>)+$")
RULE = re.compile(r"\n[ \t]*[*=_~#\u2014\u2500-]{3,}$")
# What systems leave behind where they cut a text.
MARKS = re.compile(
    "(?:(?<![.\\s])\\s*\\.\\.\\.|(?<!\u2026)\\s*\u2026{1,2}|\\s*[\\[(\uff08\u3010<](?:\\.\\.\\.|\u2026+|more|cont(?:inued|\\.)?|truncated|snip|\u4e0b\u7565|\u672a\u5b8c|\u66f4\u591a)[\\])\uff09\u3011>]|\ufffd+|(?<=[^\\s=])=)$",
    re.IGNORECASE,
)
SIGNS = np.array([ord(c) for c in "\u3002\uff1f\uff01.?!\u201d\""], dtype=np.uint32)
BROKEN_TAG = re.compile(r"</\w*$")


def core_of(text: str) -> tuple[str, bool]:
    """A text without what follows its last own character, and whether a mark of cutting was among that."""
    x, marked = text.rstrip(), False
    while True:
        y = RULE.sub("", TAGS.sub("", x)).rstrip()
        m = MARKS.search(y)
        if m and m.start() > 0:
            y, marked = y[: m.start()].rstrip(), True
        if y == x:
            return x, marked
        x = y


def closing(text: str) -> tuple[str, str]:
    """(core, verdict): `cut` or `whole` where the format of the closing tells by itself, else `ask` or `ask dot` (the corpus has to).

    What tells by itself: a row of a table with or without all its cells, a closing tag that isn't closed, a sign at which
    a sentence ends, a mark of cutting where there is none.
    """
    core, marked = core_of(text)
    if not core:
        return core, "whole"
    lines = core.split("\n")
    last = lines[-1].strip()
    if last.startswith("|"):
        first = len(lines) - 1
        while first > 0 and lines[first - 1].strip().startswith("|"):
            first -= 1
        full = last.endswith("|") and len(last) > 1 and last.count("|") >= lines[first].strip().count("|")
        return core, "whole" if full else "cut"
    if BROKEN_TAG.search(core):
        return core, "cut"
    if SENTENCE_END.search(core):
        return core, "ask dot" if NUMBER_DOT.search(core) else "whole"
    return core, "cut" if marked else "ask"


def holds_sentence(line: str) -> bool:
    """Whether a line holds a whole sentence before its last one."""
    inner = INNER_END.search(line)
    return inner is not None and (line[inner.start()] in "\u3002\uff1f\uff01" or len(line[: inner.start()].split()) > 3)


class _Contexts:
    """Hashes of the characters before each place of many texts, up to the begin of the line."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, texts: list[str]):
        joined = "\n" + "\n\n".join(texts) + "\n\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = raw.astype(np.uint64)
        codes[(raw >= 48) & (raw <= 57)] = 48
        codes[(raw == 9) | (raw == 13) | (raw == 12288) | (raw == 160)] = 32
        self.joined, self.raw, self.codes = joined, raw, codes
        n = len(codes)
        with np.errstate(over="ignore"):
            one = np.ones(1, dtype=np.uint64)
            up = np.cumprod(np.append(one, np.full(n, self.BASE, dtype=np.uint64)))
            self.down = np.cumprod(np.append(one, np.full(n, self.INVERSE, dtype=np.uint64)))
            self.sums = np.append(np.zeros(1, dtype=np.uint64), np.cumsum((codes + np.uint64(7)) * up[:n]))
        self.line = np.maximum.accumulate(np.where(raw == 10, np.arange(n), 0))
        # Words: ideographs, a third of a word each, and runs of other letters and digits.
        known = np.unique(raw)
        han = ((raw >= 0x3400) & (raw <= 0x4DBF)) | ((raw >= 0x4E00) & (raw <= 0x9FFF))
        wordly = np.isin(raw, known[[chr(c).isalnum() or c == 95 for c in known]]) & ~han
        self.starts = np.flatnonzero(han | (wordly & ~np.append(False, wordly[:-1])))
        self.thirds = np.cumsum(np.where(han[self.starts], 1, 3))
        lengths = np.array([len(t) for t in texts])
        begins = 1 + np.concatenate(([0], np.cumsum(lengths + 2)[:-1]))
        self.lasts = begins + lengths - 1

    def openings(self, at: np.ndarray) -> np.ndarray:
        """The hash of the first characters of the line of each place."""
        stops = np.append(np.flatnonzero(self.raw == 10), len(self.raw))
        end = stops[np.searchsorted(stops, at, "right")] - 1
        return self._hashed(np.maximum(self.line[at], np.minimum(self.line[at] + OPENING, end) - OPENING), np.minimum(self.line[at] + OPENING, end), OPENING, 2)

    def hashes(self, at: np.ndarray, level: int, kind: int) -> np.ndarray:
        """Of the last `level` words up to each place, the last one as far as it goes, or of those back to the line break.

        kind: 0 for the end of a line, 1 for a number and a dot.
        """
        if not len(self.starts):
            return self._hashed(self.line[at], at, level, kind)
        here = np.searchsorted(self.starts, at, "right") - 1
        upto = np.where(here >= 0, self.thirds[np.maximum(here, 0)], 0)
        first = np.searchsorted(self.thirds, upto - 3 * level, "right")
        begin = np.where(here >= 0, self.starts[np.minimum(first, len(self.starts) - 1)], 0)
        return self._hashed(np.minimum(np.maximum(self.line[at], begin), at), at, level, kind)

    def kinds(self, at: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """One of two numbers: whether the line of each place holds a whole sentence before its last."""
        return np.where(inner, np.int64(0x51AFD7ED558CCD1), np.int64(0x4CEB9FE1A85EC53))

    def _hashed(self, begin: np.ndarray, at: np.ndarray, level: int, kind: int) -> np.ndarray:
        seed = np.uint64(level * 4 + kind)
        with np.errstate(over="ignore"):
            h = (self.sums[at + 1] - self.sums[begin]) * self.down[begin] + (at - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seed
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


ASKED = T.StructType([T.StructField("_h", T.StringType()), T.StructField("_verdict", T.StringType()), T.StructField("_keys", T.ArrayType(T.LongType()))])
COUNTED = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_total", T.LongType()), T.StructField("_ends", T.LongType()), T.StructField("_other", T.LongType())])


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        closed = [closing(t) for t in pdf["_t"]]
        keys: list[list[int] | None] = [None] * len(closed)
        asked = [k for k, (_, v) in enumerate(closed) if v.startswith("ask")]
        if asked:
            contexts = _Contexts([closed[k][0] for k in asked])
            dots = np.array([closed[k][1] == "ask dot" for k in asked])
            columns = [np.where(dots, contexts.hashes(contexts.lasts, max(2, n), 1), contexts.hashes(contexts.lasts, n, 0)) for n in LEVELS]
            columns.append(contexts.openings(contexts.lasts))
            columns.append(contexts.kinds(contexts.lasts, np.array([holds_sentence(closed[k][0].split("\n")[-1]) for k in asked])))
            for row, k in enumerate(asked):
                keys[k] = [int(c[row]) for c in columns]
        yield pd.DataFrame({"_h": pdf["_h"], "_verdict": [v for _, v in closed], "_keys": pd.Series(keys, dtype=object)})


def _asked_for(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in the map."""
    slot = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def key_map(keys: DataFrame, key: str):
    """A broadcast map of the keys: KEY_BITS bits for each, never more than 2**MOST_BITS."""
    spark = keys.sparkSession
    wanted = keys.agg(F.approx_count_distinct(key)).first()[0] or 0
    size = min(MOST_BITS, max(LEAST_BITS, (KEY_BITS * wanted).bit_length()))
    slot = F.col(key).bitwiseAND(F.lit((1 << size) - 1))
    words = keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int")).alias("b"))
    bits = np.zeros(1 << (size - 6), dtype=np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # at most 2**(MOST_BITS - 6) rows, whatever the corpus
        bits[r["w"]] = r["b"]
    return spark.sparkContext.broadcast(bits.tobytes())


def _count(asked_map):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(asked_map.value, dtype=np.uint64)
        for pdf in batches:
            closed = [closing(t) for t in pdf["_t"]]
            for begin in range(0, len(closed), 1000):
                part = [c for c in closed[begin : begin + 1000] if c[0]]
                if not part:
                    continue
                contexts = _Contexts([c for c, _ in part])
                raw = contexts.raw
                after = np.append(raw[1:], 10)
                places = raw != 10
                # Where a text was cut is no place at which a line ends.
                was_cut = np.array([v == "cut" for _, v in part])
                places[contexts.lasts[was_cut]] = False
                at = np.flatnonzero(places)
                dots = np.flatnonzero((raw[1:] == 46) & (raw[:-1] >= 48) & (raw[:-1] <= 57)) + 1
                digit = (after[dots] >= 48) & (after[dots] <= 57)
                words = np.isin(after, np.unique(after)[[not chr(c).isalnum() for c in np.unique(after)]])
                last = np.zeros(len(raw), dtype=bool)
                last[contexts.lasts] = True
                lines = np.flatnonzero(places & (after == 10))
                unsigned = ~np.isin(raw[lines], SIGNS)
                keys, stops, others = [], [], []
                jobs = [(contexts.hashes(at, n, 0), (after == 10)[at], words[at]) for n in LEVELS]
                jobs += [(contexts.hashes(dots, n, 1), ~digit, ~digit) for n in LEVELS if n > 1]
                jobs.append((contexts.openings(lines), unsigned, unsigned & last[lines]))
                inner = np.array([holds_sentence(contexts.joined[b + 1 : e + 1]) for b, e in zip(contexts.line[lines], lines, strict=True)], dtype=bool)
                jobs.append((contexts.kinds(lines, inner), unsigned, unsigned & last[lines]))
                for h, stop, other in jobs:
                    hit = _asked_for(bits, h)
                    keys.append(h[hit])
                    stops.append(stop[hit])
                    others.append(other[hit])
                key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                sums = [np.bincount(inverse, w, len(key)).astype(np.int64) for w in (None, np.concatenate(stops), np.concatenate(others))]
                yield pd.DataFrame(dict(zip(COUNTED.names, (key, *sums), strict=True)))

    return count


def closings(texts: DataFrame) -> DataFrame:
    """(_h, _cut, _score, _by) of distinct texts (_h, _t): the verdict of the closing, terminality where the corpus was asked, and what decided.

    The score is the share of the places in other texts with the same closing words at which a line (after a
    number and a dot: a number) ends, for the most closing words that occur SUPPORT times elsewhere; below TERMINAL the text
    was cut, from CERTAIN it is whole. Where nearly all lines of its last line's kind end with a sign, it was cut. Between, it was cut if other
    lines that open like its last one end with a sign. It was not if those are closing lines, the last of their texts, and its last
    word is whole. Closing words that occur nowhere else leave the text whole. _by: format, line kind, opening or closing words.
    """
    asked = materialize(texts.mapInPandas(_ask, ASKED))
    keys = asked.where("_keys is not null").select("_h", F.posexplode("_keys").alias("_level", "_key"))
    seen = texts.mapInPandas(_count(key_map(keys, "_key")), COUNTED)
    seen = seen.groupBy("_key").agg(F.sum("_total").alias("_total"), F.sum("_ends").alias("_ends"), F.sum("_other").alias("_other"))
    # The two kinds of lines are asked for by every text: their counts are two rows, and don't go through the join.
    kind = F.col("_level") == len(LEVELS) + 1
    ending, opening = F.col("_level") < len(LEVELS), F.col("_level") == len(LEVELS)
    seen = materialize(seen)
    others = F.col("_total") - 1  # without the text itself
    share = ((F.col("_ends") - 1) / others).alias("_s"), ((F.col("_other") - 1) / others).alias("_w")
    known = keys.where(~kind).join(seen, "_key").where(others >= SUPPORT).select("_h", "_level", *share)
    scores = known.groupBy("_h").agg(
        F.min_by(F.when(ending, F.col("_s")), F.when(ending, F.col("_level"))).alias("_score"), F.min_by(F.when(ending, F.col("_w")), F.when(ending, F.col("_level"))).alias("_word"),
        F.max(F.when(opening, F.col("_s"))).alias("_unsigned"), F.max(F.when(opening, F.col("_w"))).alias("_closer"),
    )
    kinds = F.broadcast(seen.join(F.broadcast(keys.where(kind).select("_key").distinct()), "_key", "left_semi").where(others >= SUPPORT).select(F.col("_key").alias("_kind"), share[0].alias("_open")))
    lines = asked.select("_h", "_verdict", F.col("_keys")[len(LEVELS) + 1].alias("_kind")).join(kinds, "_kind", "left")
    prose = F.coalesce(F.col("_open") < PROSE, F.lit(False))
    by_line = (
        F.when(prose, True).when(F.col("_score") >= CERTAIN, False).when(F.col("_unsigned") < PROSE, True)
        .when((F.col("_closer") >= CLOSER) & (F.col("_word") >= 0.5), False).otherwise(F.col("_score") < TERMINAL)
    )
    cut = (
        F.when(F.col("_verdict") == "cut", True).when(F.col("_verdict") == "ask", by_line).when(F.col("_verdict") == "ask dot", F.col("_score") < TERMINAL)
    )
    by = F.when(F.col("_verdict").isin("cut", "whole"), "format").when((F.col("_verdict") == "ask") & prose, "line kind").when(
        (F.col("_verdict") == "ask") & (F.coalesce("_score", F.lit(0.0)) < CERTAIN) & (F.col("_unsigned") < PROSE), "opening"
    ).otherwise("closing words")
    return lines.join(scores, "_h", "left").select("_h", F.coalesce(cut, F.lit(False)).alias("_cut"), "_score", by.alias("_by"))


def words_of(text: str) -> list[str]:
    """The words of a text's core: ideographs, and runs of other letters and digits."""
    return WORD.findall(core_of(text)[0])


def _runs(texts: list[list[str]]) -> list[np.ndarray]:
    """The hashes of the runs of SHINGLE_WORDS words of each text, in order; a shorter text is one run."""
    lengths = [len(w) for w in texts]
    hashed = pd.util.hash_array(np.array([x for w in texts for x in w], dtype=object), categorize=True) if any(lengths) else np.empty(0, np.uint64)
    out, begin = [], 0
    factor = np.uint64(0x9E3779B97F4A7C15)
    for n in lengths:
        w = hashed[begin : begin + n]
        begin += n
        size = min(n, SHINGLE_WORDS)
        run = np.zeros(n - size + 1 if n else 0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                run = (run ^ (run >> np.uint64(29))) * factor + w[k : k + len(run)]
        out.append(run)
    return out


def heads(words: int) -> list[int]:
    """The lengths in words of the heads that a text of so many words has: HEAD, twice that, and so on."""
    return [HEAD << k for k in range(64) if HEAD << k <= words]


class _Hasher:
    """Min-hash bands and two-bit sketches of the heads of a text."""

    def __init__(self):
        rng = np.random.default_rng(20260723)
        self.a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
        self.band = rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
        self.places = np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(2)

    def __call__(self, runs: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, sketch) of each head: one number a band, and all minima in two bits each."""
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        keys, sketches, done = [], [], 0
        with np.errstate(over="ignore"):
            for n in lengths:
                upto = n - SHINGLE_WORDS + 1
                for k in range(done, upto, 2000):
                    low = np.minimum(low, (runs[k : min(k + 2000, upto), None] * self.a + self.b).min(axis=0))
                done = upto
                rows = low.reshape(BANDS, ROWS)
                h = ((rows ^ (rows >> np.uint64(31))) * self.mix).sum(axis=1) + self.band + np.uint64(n) * self.mix[0]
                h ^= h >> np.uint64(32)
                keys.append((h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
                two = ((low ^ (low >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(62)
                sketches.append(np.bitwise_or.reduce(two << self.places).view(np.int64))
        return np.array(keys, dtype=np.int64).reshape(-1, BANDS), np.array(sketches, dtype=np.int64)


BANDED = T.StructType([T.StructField("_h", T.StringType()), T.StructField("_n", T.IntegerType()), T.StructField("_key", T.LongType()), T.StructField("_sketch", T.LongType())])


def _banded(asked_map=None):
    """(_h, words, key, sketch): of texts without a sign at their end the longest head; with a map, of every text all heads asked for."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        bits = None if asked_map is None else np.frombuffer(asked_map.value, dtype=np.uint64)
        for pdf in batches:
            if bits is None:
                pdf = pdf[[closing(t)[1] != "whole" for t in pdf["_t"]]]
            for begin in range(0, len(pdf), 1000):
                part = pdf.iloc[begin : begin + 1000]
                words = [words_of(t) for t in part["_t"]]
                out = []
                for h, w, runs in zip(part["_h"], words, _runs(words), strict=True):
                    lengths = heads(len(w))
                    if not lengths:
                        continue
                    keys, sketches = hasher(runs, lengths if bits is not None else lengths[-1:])
                    flat = keys.ravel()
                    hit = np.ones(len(flat), dtype=bool) if bits is None else _asked_for(bits, flat)
                    out += [(h, len(w), int(k), int(s)) for k, s in zip(flat[hit], np.repeat(sketches, BANDS)[hit], strict=True)]
                yield pd.DataFrame(out, columns=BANDED.names)

    return rows


#: similar: the Jaccard similarity of the word shingles of a text and of as much of its copy; early: whether the first ends within a sentence of the second.
ALIGNED = T.StructType([T.StructField("similar", T.DoubleType()), T.StructField("early", T.BooleanType())])


def ends_early(short: str, long: str) -> bool:
    """Whether a text's alignment with its copy ends before the copy does, within a word, sentence or row of it.

    Only the last TAIL words are aligned, with the words of the copy around the same place.
    """
    a, b = core_of(short)[0], core_of(long)[0]
    x = WORD.findall(a)
    place = slice(max(0, len(x) - 2 * TAIL), len(x) + TAIL)
    tail = [(m.group(), m.start(), m.end()) for m in islice(WORD.finditer(b), place.stop)][place]
    x, y = x[-TAIL:], [w for w, *_ in tail]
    blocks = [m for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size]
    if not blocks:
        return False
    last = blocks[-1]
    left, right = x[last.a + last.size :], y[last.b + last.size :]
    if not right or len(left) > 1:
        return False
    if left:
        return right[0].startswith(left[0]) and len(right[0]) > len(left[0])  # within a word
    between = b[tail[last.b + last.size - 1][2] : tail[last.b + last.size][1]]
    return re.search("[\u3002\uff1f\uff01.?!\n]", between) is None


@F.pandas_udf(ALIGNED)
def _align(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    similar, early = [], []
    for a, b in zip(short, long, strict=True):
        words = words_of(a)
        s, t = (np.unique(r) for r in _runs([words, words_of(b)[: len(words)]]))
        both = len(np.intersect1d(s, t, assume_unique=True))
        similar.append(both / max(1, len(s) + len(t) - both))
        early.append(similar[-1] >= SIMILARITY and ends_early(a, b))
    return pd.DataFrame({"similar": similar, "early": early})


def near_copies(texts: DataFrame) -> DataFrame:
    """(_h, _of, similar, early) of distinct texts (_h, _t): texts without a sign at their end, and longer near-copies of theirs.

    A text is looked for by its longest head of HEAD x 2**k words, and found in every longer text that has a similar head of that length,
    so a copy may be cut anywhere. Of the other texts only bands that somebody asks for are moved. Candidates are held
    against each other by the sketches in their rows, then by their texts: the short one against as many words of the long one. Keys that
    many texts share are split by Spark as skewed partitions of a join. Texts of fewer than HEAD words have no copies.
    """
    asked = materialize(texts.mapInPandas(_banded(), BANDED))
    held = texts.mapInPandas(_banded(key_map(asked, "_key")), BANDED).select(F.col("_h").alias("_of"), F.col("_n").alias("_m"), "_key", F.col("_sketch").alias("_o"))
    other = F.col("_sketch").bitwiseXOR(F.col("_o"))
    differ = F.bit_count(other.bitwiseOR(F.shiftrightunsigned(other, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    longer = (F.col("_m") > F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("_of") != F.col("_h")))
    pairs = asked.join(held, "_key").where(longer & (differ <= BANDS * ROWS - AGREEING)).select("_h", "_of").distinct()
    left = pairs.join(texts.select("_h", "_t"), "_h")
    both = left.join(texts.select(F.col("_h").alias("_of"), F.col("_t").alias("_o")), "_of")
    return both.select("_h", "_of", _align("_t", "_o").alias("_x")).select("_h", "_of", "_x.*").where(F.col("similar") >= SIMILARITY)


def truncated(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, cut, by_copy, terminality, route) of every document that has a text.

    by_copy: a longer near-copy shows the cut. route: what decided (copy, format, line kind, opening, closing words), null for blank
    texts. Null, empty and blank texts are never cut, and copies of one text share its verdict. Rows with a null doc are left
    out. Extra columns are ignored.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(doc).alias("_d"), F.col(text).alias("_t")).where(F.col("_d").isNotNull() & F.col("_t").isNotNull()).withColumn("_h", F.md5(F.col("_t")))
    texts = materialize(rows.select("_h", "_t").where(~F.col("_t").rlike(r"^\s*$")).dropDuplicates(["_h"]))
    copies = near_copies(texts).groupBy("_h").agg(F.bool_or("early").alias("_early"))
    verdicts = closings(texts).join(copies, "_h", "left")
    out = rows.select("_d", "_h").join(verdicts, "_h", "left")
    early = F.coalesce("_early", F.lit(False))
    return out.select(
        F.col("_d").alias(doc), (early | F.coalesce("_cut", F.lit(False))).alias("cut"), early.alias("by_copy"), F.col("_score").alias("terminality"),
        F.when(early, "copy").otherwise(F.col("_by")).alias("route"),
    )
