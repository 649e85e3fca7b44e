"""Visually identical text with different characters (problem 1).

Each token's letters have the sets of scripts in which they can be spelled without looking different. Their intersection
tells in which scripts the whole token can be spelled: so letters that stand in for those of another script are found
in mixed tokens and in tokens wholly of stand-ins, and the consistent spelling is chosen. Compatibility forms of letters,
digits and ideographs, combining marks, invisible characters and unusual spaces are brought to their plain form.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import ship_package

# Letters that look like a Latin one, pairwise.
CYRILLIC_LATIN = "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҮY ԚQ ԜW ӀI аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl үy"
GREEK_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ νv οo ϲc ϳj"
ARMENIAN_LATIN = "ՍU ՕO Տs ԼL Ւr հh ոn սu օo ցg զq քf յj"
CHEROKEE_LATIN = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ"
# Greek letters that look like a Latin one within a word, but stand by themselves or at its ends as symbols.
GREEK_INNER = "αa γy ιi κk ρp τt υu ωw"
# Latin letters that look like another Latin one.
LATIN_INNER = "ɑa ɡg"
# Katakana that look like an ideograph, pairwise.
KANA_HAN = "エ工 カ力 ニ二 ロ口 ハ八 タ夕 ト卜 オ才 チ千 ヌ又 ヒ匕 ノ丿 ー一"
# Signs of units that are compatibility forms of letters.
UNIT_SIGNS = "\u00b5\u2126\u212a\u212b"

PAIRS = {"CYRILLIC": CYRILLIC_LATIN, "GREEK": GREEK_LATIN, "ARMENIAN": ARMENIAN_LATIN, "CHEROKEE": CHEROKEE_LATIN}
SYMBOLS = {p[0]: p[1] for p in GREEK_INNER.split()}
TO_LATIN = {p[0]: p[1] for pairs in PAIRS.values() for p in pairs.split()} | SYMBOLS
FROM_LATIN = {(s, p[1]): p[0] for s, pairs in PAIRS.items() for p in pairs.split()}
LATIN_FORMS = {p[0]: p[1] for p in LATIN_INNER.split()}
TO_HAN = {p[0]: p[1] for p in KANA_HAN.split()}
ALPHABETS = ("LATIN", *PAIRS)

#: Texts of these characters alone are plain; only the others are looked at closely.
PLAIN = (
    r"^[\t\n\r\u0020-\u007e\u00a1-\u00ac\u00ae-\u00b4\u00b6-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3"
    r"\u01cd-\u01f0\u01f4-\u0250\u0252-\u0260\u0262-\u02af\u2010-\u2027\u2030-\u205e\u2190-\u22ff\u3001-\u3004\u3008-\u301f\u3400-\u4dbf\u4e00-\u9fff"
    r"\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff60]*$"
)


@lru_cache(maxsize=65_536)
def script(char: str) -> str:
    """One of ALPHABETS, HAN, KANA or "" (anything else)."""
    if unicodedata.category(char)[0] not in "LM":
        return "KANA" if char == "ー" else ""
    name = unicodedata.name(char, "")
    for s in ALPHABETS:
        if name.startswith(s):
            return s
    if name.startswith("CJK "):
        return "HAN"
    return "KANA" if name.startswith(("KATAKANA", "HIRAGANA")) else ""


@lru_cache(maxsize=65_536)
def spellable(char: str) -> frozenset[str]:
    """The scripts in which a letter has a form that looks the same."""
    own = script(char)
    latin = char if own == "LATIN" else TO_LATIN.get(char)
    if latin is None:
        return frozenset({own})
    return frozenset({own, "LATIN"} | {s for s in ALPHABETS if (s, latin) in FROM_LATIN})


def respell(char: str, target: str) -> str:
    """A letter's form in another script that looks the same."""
    if script(char) == target:
        return char
    latin = TO_LATIN.get(char, char)
    return latin if target == "LATIN" else FROM_LATIN[target, latin]


@lru_cache(maxsize=65_536)
def plain_form(char: str) -> tuple[str, str]:
    """(form, kind) of a character by itself; the kind is "" if it is plain."""
    category = unicodedata.category(char)
    if category == "Zs":
        return (" ", "space") if char != " " else (char, "")
    if category == "Cf" or "\ufe00" <= char <= "\ufe0f" or char in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or (category == "Cc" and char not in "\t\n\x0b\x0c\r\x85"):
        return "", "invisible"
    if "\u0300" <= char <= "\u036f" or "\u1ab0" <= char <= "\u1aff" or "\u1dc0" <= char <= "\u1dff" or "\u20d0" <= char <= "\u20ff" or "\ufe20" <= char <= "\ufe2f" or char in "゙゚":
        return char, "combining mark"
    how = unicodedata.decomposition(char)
    if not how or char in UNIT_SIGNS or "\u3130" <= char <= "\u318f":
        return char, ""
    tag = how.split()[0] if how[0] == "<" else ""
    form = unicodedata.normalize("NFKC", char)
    if form == char or tag in ("<super>", "<sub>", "<square>", "<fraction>", "<circle>", "<noBreak>"):
        return char, ""
    letters = all(unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" for c in form)
    source = category[0] == "L" or category == "Nd" or script(form[0]) == "HAN"
    return (form, "compatibility form") if letters and source else (char, "")


def _joins(text: str, i: int) -> bool:
    """Whether an invisible character at i joins what belongs together: parts of an emoji, or letters of cursive scripts."""
    char = text[i]
    if char not in "\u200c\u200d\ufe0e\ufe0f" or i == 0:
        return False
    before, after = text[i - 1], text[i + 1] if i + 1 < len(text) else ""
    if char in "\ufe0e\ufe0f":
        return unicodedata.category(before) in ("So", "Sm") or before in "0123456789#*"
    pictures = lambda c: bool(c) and (unicodedata.category(c) in ("So", "Sk") or c == "\ufe0f")
    cursive = lambda c: bool(c) and unicodedata.category(c)[0] in "LM" and unicodedata.name(c, "").startswith(("ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "GUJARATI", "GURMUKHI", "SYRIAC", "MONGOLIAN"))
    return (pictures(before) and pictures(after)) or (cursive(before) and cursive(after))


def _tokens(text: str, scripts: tuple[str, ...]) -> list[tuple[int, int]]:
    """Begin and end of each run of letters of the given scripts."""
    out, begin = [], None
    for i, char in enumerate(text):
        inside = script(char) in scripts
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            out.append((begin, i))
            begin = None
    return out + ([(begin, len(text))] if begin is not None else [])


def _consistent(token: str, others: list[str]) -> str | None:
    """The script in which a token ought to be spelled; None if it is as it ought to be. others: the tokens beside it."""
    present = {script(c) for c in token}
    common = frozenset.intersection(*map(spellable, token))
    if len(present) == 1:
        own = next(iter(present))
        if own == "LATIN" or "LATIN" not in common or any(c in SYMBOLS for c in token):
            return None
        # A token wholly of stand-ins is meant as it is beside a word that only its script can spell.
        if any(frozenset.intersection(*map(spellable, t)) == {own} for t in others):
            return None
        if len(token) == 1 and own == "GREEK" and token.islower() and token != "ο":
            return None
        return "LATIN"
    if not common:
        return None
    # Where the word can be spelled in several scripts, Latin is meant unless a word beside it can't be Latin.
    beside = [script(c) for t in others for c in t if len(spellable(c)) == 1]
    return next((x for x in sorted(common) if x != "LATIN" and x in beside and "LATIN" not in beside), "LATIN" if "LATIN" in common else min(common))


def normalize(text: str) -> tuple[str, list[str]]:
    """(plain text, kinds of unplain characters found, in order, once each)."""
    kinds: dict[str, None] = {}
    out = []
    for i, char in enumerate(text):
        form, kind = plain_form(char)
        if kind == "invisible" and _joins(text, i):
            form, kind = char, ""
        if kind:
            kinds[kind] = None
        out.append(form)
    chars = list(unicodedata.normalize("NFC", "".join(out)) if "combining mark" in kinds else "".join(out))
    plain = "".join(chars)
    if any(c in TO_LATIN or c in TO_HAN or c in LATIN_FORMS or script(c) in PAIRS for c in plain):
        spans = _tokens(plain, ALPHABETS)
        words = [plain[b:e] for b, e in spans]
        for k, (b, e) in enumerate(spans):
            # Symbols of another script may lead or end a Latin word; they are meant.
            while e - b > 1 and _symbol(plain[b]) and any("LATIN" in spellable(c) and c not in SYMBOLS for c in plain[b + 1 : e]):
                b += 1
            while e - b > 1 and _symbol(plain[e - 1]) and any(script(c) == "LATIN" for c in plain[b : e - 1]):
                e -= 1
            target = _consistent(plain[b:e], words[max(0, k - 1) : k] + words[k + 1 : k + 2])
            if target:
                chars[b:e] = [respell(c, target) for c in plain[b:e]]
                kinds["stand-in letter"] = None
            word = chars[b:e]
            # A Latin letter that looks like another one stands in for it where all others are of the basic alphabet.
            if any(c in LATIN_FORMS for c in word) and any(c.isascii() for c in word) and all(c.isascii() or c in LATIN_FORMS for c in word):
                chars[b:e] = [LATIN_FORMS.get(c, c) for c in word]
                kinds["stand-in letter"] = None
        for b, e in _tokens(plain, ("HAN", "KANA")):
            if any(script(c) == "HAN" for c in plain[b:e]) and _stand_in_kana(plain, b, e, chars):
                kinds["stand-in ideograph"] = None
        # Stand-ins with no ideograph beside them are read by the text: as ideographs, unless it has kana that look like none.
        kana = [c for c in plain if script(c) == "KANA"]
        if kana and all(c in TO_HAN for c in kana) and any(script(c) == "HAN" for c in plain):
            chars = [TO_HAN.get(c, c) for c in chars]
            kinds["stand-in ideograph"] = None
    return "".join(chars), list(kinds)


def _symbol(char: str) -> bool:
    """Whether a letter may be a Greek symbol at the end of a Latin word."""
    return script(char) == "GREEK" and ("LATIN" not in spellable(char) or char in SYMBOLS)


def _stand_in_kana(plain: str, begin: int, end: int, chars: list[str]) -> bool:
    """Respell the runs of kana of a token that are stand-ins throughout; of several kana only where the text has no others."""
    real = any(script(c) == "KANA" and c not in TO_HAN for c in plain)
    done = False
    for b, e in _tokens(plain[begin:end], ("KANA",)):
        run = plain[begin + b : begin + e]
        if all(c in TO_HAN for c in run) and (len(run) == 1 or not real):
            chars[begin + b : begin + e] = [TO_HAN[c] for c in run]
            done = True
    return done


FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(FOUND)
def _normalized(texts: pd.Series) -> pd.DataFrame:
    done = [normalize(t) if t is not None else (None, None) for t in texts]
    return pd.DataFrame({"text": [d[0] for d in done], "kinds": pd.Series([d[1] for d in done], dtype=object)})


def normalized(df: DataFrame, record: str, fields: tuple[str, ...], table: str) -> DataFrame:
    """(table_name, record_id, field_name, text, kinds) of every text: its plain form and what was found in it.

    Rows without a record id are left out; rows delivered twice count once; null and empty texts come out as they are
    with no kinds. Extra columns are ignored. Texts of plain characters alone never leave the JVM.
    """
    ship_package(df.sparkSession)
    pairs: list[Column] = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("t")) for f in fields]
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record_id"), F.explode(F.array(*pairs)).alias("_f"))
    once = rows.select("record_id", "_f.field_name", F.col("_f.t").alias("_t")).distinct()
    closely = once.withColumn("_x", _normalized(F.when(~F.col("_t").rlike(PLAIN), F.col("_t"))))
    return closely.select(
        F.lit(table).alias("table_name"), "record_id", "field_name", F.coalesce("_x.text", "_t").alias("text"),
        F.coalesce("_x.kinds", F.array().cast("array<string>")).alias("kinds"),
    )
