import random
from difflib import SequenceMatcher

import pytest

from lodestrand.llm.overlap import comparable, cross_split_overlaps, similar_pairs

FOLDS = "batch_id string, outer_test_fold int, train_question_ids array<string>, test_question_ids array<string>, folds string"
QUESTIONS = "question_id string, query_text string, similarity string"


def change(text, k):
    chars = list(text)
    for _ in range(k):
        p = random.randrange(len(chars))
        random.choice([lambda p: chars.insert(p, random.choice("abc库")), lambda p: chars.pop(p) if len(chars) > 1 else None, lambda p: chars.__setitem__(p, "x")])(p)
    return "".join(chars)


@pytest.mark.parametrize("threshold", [0.85, 0.6, 1.0])
def test_all_similar_pairs_are_found(threshold):
    random.seed(7)
    texts = ["", "a", "ab", "abc", "库存", "库存量"] + ["".join(random.choice("abcde库存量表") for _ in range(random.randrange(1, 60))) for _ in range(40)]
    texts += [change(t, random.randrange(0, 1 + len(t) // 8)) for t in texts if t] + texts[:10]
    got = {(i, j): r for i, j, r in similar_pairs(texts, texts, threshold)}
    want = {(i, j): r for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and (r := SequenceMatcher(None, a, b).ratio()) >= threshold}
    assert got == want


def test_long_texts():
    random.seed(4)
    text = "".join(chr(0x4E00 + random.randrange(6000)) for _ in range(40_000))
    near = text[:39_000] + "x" + text[39_001:]
    got = {(i, j): r for i, j, r in similar_pairs([text], [text, near, text[::-1]], 0.85)}
    assert got == {(0, 0): 1.0, (0, 1): pytest.approx(1 - 1 / 40_000)}


def test_comparable():
    assert comparable("Ｈello, Wor_ld! ß 表1。") == "hellowor_ldss表1"


def test_pairs_of_one_row_only(spark):
    text = "during a routine inspection may the holder postpone the reduced testing"
    questions = [("a", text + " scheme", ""), ("b", "Q: " + text + " scheme?", ""), ("c", text + " plan", ""), ("d", None, ""), ("e", "", ""), ("f", "..", ""), ("g", "something else altogether is asked here", ""), ("h", text + " scheme", "")]
    folds = [("B", 0, ["b", "c", "d", "e", "missing", None, "b"], ["a", "g", "d", "f"], ""), ("B", 0, ["b", "c", "d", "e", "missing", None, "b"], ["a", "g", "d", "f"], ""), ("C", 1, ["h"], ["g"], ""), (None, 1, ["h"], ["a"], "")]
    for block in (2048, 2):
        found = cross_split_overlaps(spark.createDataFrame(folds, FOLDS), spark.createDataFrame(questions, QUESTIONS), block=block)
        got = sorted((r["batch"], r["evaluated"], r["trained"], r["folds"]) for r in found.collect())
        assert got == [("B", "a", "b", ["0"]), ("B", "a", "c", ["0"])]


def test_any_fold(spark):
    questions = [("a", "the very same text", ""), ("b", "the very same text", "")]
    folds = [("B", f, ["b"], ["a"], "") for f in (62, 63, 100, -1, None)] + [("B", 7, ["a"], ["b"], "")]
    found = cross_split_overlaps(spark.createDataFrame(folds, FOLDS), spark.createDataFrame(questions, QUESTIONS)).collect()
    assert sorted((r["evaluated"], r["folds"]) for r in found) == [("a", ["", "-1", "100", "62", "63"]), ("b", ["7"])]


def test_blocks_lose_nothing(spark):
    random.seed(9)
    texts = ["".join(random.choice("abcde库存量表") for _ in range(random.randrange(1, 60))) for _ in range(60)]
    texts += [change(t, random.randrange(0, 1 + len(t) // 8)) for t in texts] + texts[:10]
    questions = [(f"q{i:03}", t, "") for i, t in enumerate(texts)]
    folds = [("B", f, [q for i, (q, *_) in enumerate(questions) if i % 3 != f], [q for i, (q, *_) in enumerate(questions) if i % 3 == f], "") for f in range(3)]
    plain = [comparable(t) for t in texts]
    want = sorted((f"q{i:03}", f"q{j:03}") for i, a in enumerate(plain) for j, b in enumerate(plain) if i % 3 != j % 3 and SequenceMatcher(None, a, b).ratio() >= 0.85)
    for block in (2048, 7):
        found = cross_split_overlaps(spark.createDataFrame(folds, FOLDS), spark.createDataFrame(questions, QUESTIONS), block=block)
        assert sorted((r["evaluated"], r["trained"]) for r in found.collect()) == want


def test_empty(spark):
    assert cross_split_overlaps(spark.createDataFrame([], FOLDS), spark.createDataFrame([], QUESTIONS)).count() == 0
