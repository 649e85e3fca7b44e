import pytest

from lodestrand.llm.lookalikes import normalize, normalized


@pytest.mark.parametrize(("text", "plain"), [
    ("САRRYING", "CARRYING"), ("Οnly the", "Only the"), ("lіftеd", "lifted"), ("a а fixed", "a a fixed"), ("人エ搬运", "人工搬运"), ("压カ", "压力"),
    ("ＭＰａ １２", "MPa 12"), ("⽤于", "用于"), ("不适用", "不适用"), ("eﬀect", "effect"), ("crème", "crème"), ("he​l­lo﻿", "hello"), ("a b　c", "a b c"),
    ("ѕсоre", "score"),
])
def test_stand_ins_are_found(text, plain):
    got, kinds = normalize(text)
    assert got == plain and kinds and normalize(got) == (got, [])


@pytest.mark.parametrize("text", [
    "", "«Осторожно» in", "не с ним", "β-lactam", "采用Δp法", "Slope λ and offset Δ", "10 m² at 5 °C", "µg ℃ ½ ①", "（见表5），好。", "2–8 — …", "line\nbreak\ttab", "café naïve", "カタカナ と 工", "👩‍🔬 ok", "x" * 20000,
])
def test_meant_characters_stay(text):
    assert normalize(text) == (text, [])


def test_table(spark):
    rows = [("1", "plаin", None, "t"), ("1", "plаin", None, "t"), ("2", "", "ok", "t"), (None, "​", "​", "t"), ("3", "​​", "a b", "t")]
    df = spark.createDataFrame(rows, "id string, heading string, content string, text string")
    got = {(r["record_id"], r["field_name"]): (r["text"], r["kinds"]) for r in normalized(df, "id", ("heading", "content"), "t").collect()}
    assert len(got) == 6 and got["1", "heading"] == ("plain", ["stand-in letter"]) and got["1", "content"] == (None, []) and got["3", "heading"] == ("", ["invisible"]) and got["3", "content"] == ("a b", ["space"])
    assert normalized(df.where("false"), "id", ("heading",), "t").count() == 0


def test_stand_ins_of_more_alphabets_and_by_token():
    cases = {
        "ɡood": "good", "ɑlphɑ": "alpha", "Ꭺpple": "Apple", "tոte": "tnte", "ՕUTPUT": "OUTPUT", "meαsure": "measure", "sτorage": "storage", "ӀNPUT": "INPUT",
        "ニ次加工 データ": "二次加工 データ", "ロ服 エ業": "口服 工業",
    }
    for text, plain in cases.items():
        assert normalize(text)[0] == plain and normalize(text)[1], text
    # What is meant stays: symbols, transcriptions, words of another script, Japanese words.
    for text in ("α-pinene", "αD", "μg", "kρ", "ɡ", "ɡʊd", "ρ", "αρ", "Եւ ոչ", "Хлеб и вода", "データ加工", "カード 支払", "β-blocker"):
        assert normalize(text) == (text, []), text
