"""Column functions over text: folding, tokens, spellings, similarity."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import ship_package

# The characters whose case folding differs from lower case in its Latin letters, with their folding.
FOLDINGS = {
    "\u00df": "ss", "\u017f": "s", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st",
    "\ufb06": "st", "\u0149": "\u02bcn", "\u01f0": "j\u030c", "\u1e96": "h\u0331", "\u1e97": "t\u0308", "\u1e98": "w\u030a",
    "\u1e99": "y\u030a", "\u1e9a": "a\u02be",
}


def fold(col: Column | str) -> Column:
    """Lower case with the letters above folded: equal to full case folding as far as the letters a to z go."""
    out = F.lower(col)
    for char, folded in FOLDINGS.items():
        out = F.replace(out, F.lit(char), F.lit(folded))
    return out


def latin_tokens(col: Column | str) -> Column:
    """All runs of a-z and 0-9 of the folded text, in order."""
    return F.regexp_extract_all(fold(col), F.lit("([a-z0-9]+)"), F.lit(1))


def han_bigrams(col: Column | str) -> Column:
    """Overlapping pairs of each run of ideographs, in order; a lone ideograph stands by itself."""
    runs = F.regexp_extract_all(col if isinstance(col, Column) else F.col(col), F.lit("([\\x{4e00}-\\x{9fff}]+)"), F.lit(1))
    return F.flatten(
        F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2)))))
    )


def search_tokens(col: Column | str) -> Column:
    """The tokens of a mixed-language index: Latin tokens, then ideograph pairs; null text gives none."""
    text = F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit(""))
    return F.concat(latin_tokens(text), han_bigrams(text))


def index_text(*parts: str, limit: int | None = None) -> Column:
    """Trimmed non-blank parts joined by line breaks, whole; `limit` cuts to so many characters (the pharmaceutical reference: 2,000)."""
    whole = F.concat_ws("\n", *[F.nullif(F.trim(F.col(p)), F.lit("")) for p in parts])
    return whole if limit is None else F.substring(whole, 1, limit)


def slug(col: Column | str) -> Column:
    """One spelling of a category: lower case words joined by underscores."""
    words = F.regexp_replace(F.lower(col if isinstance(col, Column) else F.col(col)), r"[^\p{L}\p{N}]+", "_")
    return F.regexp_replace(words, r"^_+|_+$", "")


def half_even(col: Column | str, places: int) -> Column:
    """A number rounded to so many places, halves to the even neighbour."""
    return F.bround(col, places)


def first_filled(*cols: Column | str) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c if isinstance(c, Column) else F.col(c)), F.lit("")) for c in cols])


def search_phrase(col: Column | str) -> Column:
    """A query for a full-text index: its operators become blanks, blanks collapse; null if nothing is left."""
    plain = F.regexp_replace(col if isinstance(col, Column) else F.col(col), r'[+\-&|!(){}\[\]^"~*?:\\/]', " ")
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def contains_any(text: Column, cues: list[str]) -> Column:
    """Whether the text contains one of the cues; false for null text. One pattern, so the text is worked out once."""
    return F.coalesce(F.rlike(text, F.lit("|".join(map(re.escape, cues)))), F.lit(False))


def normalize_text(text: str, form: str) -> str:
    """cue: compatibility form, case folded, blanks collapsed; question: letters, digits and underscores of that alone; NFC."""
    if form == "NFC":
        return unicodedata.normalize("NFC", text)
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(folded.split()) if form == "cue" else "".join(re.findall(r"\w+", folded))


def normalized(col: Column | str, form: str) -> Column:
    """normalize_text on a column, in Arrow batches; null stays null."""
    ship_package(SparkSession.active())

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else normalize_text(t, form) for t in texts], dtype=object)

    return of(col)


def similarity(a: str, b: str) -> float:
    """The share of matching blocks of two texts, the order of which counts."""
    return SequenceMatcher(None, a, b).ratio()


def block_similarity(left: Column | str, right: Column | str) -> Column:
    """similarity on columns; null if either is null."""
    ship_package(SparkSession.active())

    @F.pandas_udf(T.DoubleType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return of(left, right)
