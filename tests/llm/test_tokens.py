import os
import random

import pytest

from lodestrand.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
ALPHABETS = ["abcdefgh ", "  \n\tab", "'s't're'll x", "中文字符，。 ab", "0123456789 ", "''''!!--", "aA1 ́é😀", "a", " ", "中", "'", "\x1c\x85 a"]


def test_joins_equal_whole_encoding():
    bpe = tokens.encoding()
    random.seed(3)
    for _ in range(3000):
        a, b = random.choice(ALPHABETS), random.choice(ALPHABETS)
        text = "".join(random.choice(a) for _ in range(random.randrange(120))) + "".join(random.choice(b) for _ in range(random.randrange(120)))
        cut = random.randint(0, len(text))
        got = tokens.join_ids(bpe.encode_ordinary(text[:cut]), bpe.encode_ordinary(text[cut:]), window=random.choice([1, 2, 8]))
        assert got == bpe.encode_ordinary(text), repr(text)


def test_agrees_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("Hello <|endoftext|> world", "危险化学品 12.5 mg/m³", "a" * 5000, " " * 3000 + "x", "don't 'll"):
        assert tokens.encoding().encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


def test_corpus(spark):
    bpe = tokens.encoding()
    texts = [None, "", "short", "x" * 5000, "危险" * 3000, " " * 1000 + "word " * 500, "0" * 4097, "a'" * 2500]
    rows = [(k, t, [9]) for k, t in enumerate(texts)] + [(3, texts[3], [9]), (None, "no id", [9])]
    got = tokens.encode_corpus(spark.createDataFrame(rows, "doc bigint, text string, ids array<int>"), "doc", "text", piece_chars=500).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == (bpe.encode_ordinary(texts[r["doc"]] or "") if r["doc"] is not None else bpe.encode_ordinary("no id"))
    assert tokens.encode_corpus(spark.createDataFrame([], "doc bigint, text string"), "doc", "text").count() == 0
