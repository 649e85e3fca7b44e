import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.functions import text
from lodestrand.functions.hashing import hash_fold, joined_hash
from lodestrand.functions.numbering import number_rows


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_tokens_equal_full_case_folding(spark):
    values = ["Straße ﬁt ﬀ ſo", "ǰẖẗẘẙẚŉ", "ABC-12 def", "", None, "中文字 12 字"] + [chr(c) + "a" for c in range(0x80, 0x600)]
    got = [r[0] for r in column(spark, values).select(text.latin_tokens("x")).collect()]
    assert got == [None if v is None else re.findall("[a-z0-9]+", v.casefold()) for v in values]


def test_search_tokens(spark):
    got = [r[0] for r in column(spark, ["危险化学品 at 5 字", None, "字", ""]).select(text.search_tokens("x")).collect()]
    assert got == [["at", "5", "危险", "险化", "化学", "学品", "字"], [], ["字"], []]


def test_slug_and_phrase(spark):
    rows = column(spark, [" Direct  Clause", "direct-clause", "DIRECT_CLAUSE ", None]).select(text.slug("x")).collect()
    assert [r[0] for r in rows] == ["direct_clause"] * 3 + [None]
    rows = column(spark, ['a && (b) "c" *', "+-", None]).select(text.search_phrase("x")).collect()
    assert [r[0] for r in rows] == ["a b c", None, None]


def test_hashes(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)]
    got = [r[0] for r in column(spark, digests).select(hash_fold(F.col("x"))).collect()]
    assert got == [int(d, 16) % 5 for d in digests]
    assert column(spark, ["q"]).select(joined_hash("x", F.lit("b"), length=20)).first()[0] == hashlib.sha256(b"q\0b").hexdigest()[:20]


def test_numbering_is_the_sorted_order(spark):
    values = [f"v{i}" for i in range(500)]
    got = {r["x"]: r["number"] for r in number_rows(column(spark, values), F.sha2("x", 256), "x").collect()}
    order = sorted(values, key=lambda v: hashlib.sha256(v.encode()).hexdigest())
    assert got == {v: k + 1 for k, v in enumerate(order)}
    assert number_rows(column(spark, []), F.sha2("x", 256), "x").count() == 0


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=20))
def test_question_form_is_stable(value):
    once = text.normalize_text(value, "question")
    assert re.sub(r"\w", "", once) == ""


def test_index_text_is_whole(spark):
    df = spark.createDataFrame([(" Head ", "a " * 3000 + "last")], "heading string, content string")
    row = df.select(text.index_text("heading", "content").alias("whole"), text.index_text("heading", "content", limit=2000).alias("cut")).first()
    assert row["whole"] == "Head\n" + "a " * 3000 + "last" and row["cut"] == row["whole"][:2000]
