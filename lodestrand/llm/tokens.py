"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 7).

Texts of ordinary length are encoded as they are. Longer ones are cut into pieces that are encoded in parallel and joined
pairwise, level by level. At each join a growing window around it is encoded again until both sides agree with it, so
that the ids are exactly those of the whole text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import materialize, ship_package

#: Where each machine keeps the vocabulary: a file of base64 tokens and their ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before this vocabulary is applied.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 4096

IDS = T.ArrayType(T.IntegerType(), containsNull=False)


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The encoder of a vocabulary file, loaded once a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=65_536)
def _kind(char: str) -> str:
    """L letter, N number, W white space, O other, or ? where libraries may disagree."""
    category = unicodedata.category(char)
    if char in "\x1c\x1d\x1e\x1f\x85᠎" or category == "Cn":
        return "?"
    if category[0] in "LN":
        return category[0]
    return "W" if char in "\t\n\x0b\x0c\r" or category[0] == "Z" else "O"


def _always_split(a: str, b: str) -> bool:
    """Whether the pattern ends a piece between two characters whatever stands around them."""
    x, y = _kind(a), _kind(b)
    if x in "W?" or y == "?" or x == y:
        return False
    return y == "W" or not (a == "'" and y == "L")


def join_ids(left: list[int], right: list[int], path: str = VOCABULARY, window: int = 8) -> list[int]:
    """The ids of a text from the ids of its two parts, each encoded by itself.

    The window of `window` ids on either side grows until (a) its text has, on both sides of the join, a place at which
    every text is split, and only what is between them is encoded anew; or (b) it lies within one run of
    letters, numbers or other signs, and its own encoding begins and ends with the ids that are there already: as
    byte-pair encoding is exact wherever all neighbouring ids are, the rest then stands; or (c) it is everything.
    """
    if not left or not right:
        return left or right
    bpe = encoding(path)
    while True:
        n, m = min(window, len(left)), min(window, len(right))
        whole_left, whole_right = n == len(left), m == len(right)
        window *= 2
        before, after = bpe.decode_bytes(left[-n:]), bpe.decode_bytes(right[:m])
        if whole_left and whole_right:
            return bpe.encode_ordinary((before + after).decode())
        try:
            a, b = before.decode(), after.decode()
        except UnicodeDecodeError:  # the window begins or ends within a character
            continue
        begin = next((i for i in range(len(a) - 1, 0, -1) if _always_split(a[i - 1], a[i])), 0 if whole_left else None)
        end = next((i for i in range(1, len(b)) if _always_split(b[i - 1], b[i])), len(b) if whole_right else None)
        if begin is not None and end is not None:
            keep, rest = len(a[:begin].encode()), len(b[:end].encode())
            head = _upto(bpe, left[-n:], keep)
            tail = _upto(bpe, right[:m], rest)
            if head is not None and tail is not None:
                return left[: len(left) - n + head] + bpe.encode_ordinary(a[begin:] + b[:end]) + right[tail:]
        kinds = set(map(_kind, a + b))
        # Two letters of the run must stand on the left, so that its start is no contraction that goes on to the right.
        if len(kinds) == 1 and kinds <= {"L", "N", "O"} and len(a) > 1:
            fresh = bpe.encode_ordinary(a + b)
            if len(fresh) > 1 and fresh[0] == left[-n] and fresh[-1] == right[m - 1]:
                return left[:-n] + fresh + right[m:]


def _upto(bpe, ids: list[int], size: int) -> int | None:
    """How many of the ids make up the first `size` bytes; None if no id ends there."""
    done = 0
    for k, i in enumerate(ids):
        if done >= size:
            return k if done == size else None
        done += len(bpe.decode_single_token_bytes(i))
    return len(ids) if done == size else None


def _encoder(path: str):
    @F.pandas_udf(IDS)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoding(path)
        for texts in batches:
            yield pd.Series([[] if x is None else bpe.encode_ordinary(x) for x in texts], index=texts.index, dtype=object)

    return encode


def _joiner(path: str):
    @F.pandas_udf(IDS)
    def join(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [join_ids(list(map(int, a)), [] if b is None else list(map(int, b)), path) for a, b in zip(left, right, strict=True)], dtype=object
        )

    return join


def encode_corpus(df: DataFrame, doc: str, text: str, vocabulary: str = VOCABULARY, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc, ids): the ids of each text, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list, a null doc keeps its row, repeated rows stay. Extra columns are ignored. Texts of
    more than `piece_chars` characters are cut into pieces of that size, spread over all tasks, and joined.
    """
    if piece_chars < 1:
        raise ValueError("piece_chars must be positive")
    ship_package(df.sparkSession)
    rows = df.select(F.col(doc).alias("_d"), F.col(text).alias("_t"))
    encode, join = _encoder(vocabulary), _joiner(vocabulary)
    is_long = F.coalesce(F.length("_t") > piece_chars, F.lit(False))
    short = rows.where(~is_long).select("_d", encode("_t").alias("_ids"))
    starts = F.sequence(F.lit(1), F.length("_t"), F.lit(piece_chars))
    pieces = (
        rows.where(is_long)
        .withColumn("_u", F.expr("uuid()"))  # tells apart rows with the same doc
        .select("_d", "_u", F.posexplode(F.transform(starts, lambda s: F.substring("_t", s, F.lit(piece_chars)))).alias("_k", "_p"))
    )
    level = materialize(materialize(pieces).repartition("_u", "_k").select("_d", "_u", "_k", encode("_p").alias("_ids")))
    most = (level.agg(F.max("_k")).first()[0] or 0) + 1
    while most > 1:
        left = level.where("_k % 2 = 0").select("_d", "_u", (F.col("_k") / 2).cast("int").alias("_k"), "_ids")
        right = level.where("_k % 2 = 1").select("_u", ((F.col("_k") - 1) / 2).cast("int").alias("_k"), F.col("_ids").alias("_r"))
        level = materialize(left.join(right, ["_u", "_k"], "left").select("_d", "_u", "_k", join("_ids", "_r").alias("_ids")))
        most = -(-most // 2)
    return short.unionByName(level.select("_d", "_ids")).select(F.col("_d").alias(doc), F.col("_ids").alias("ids"))
