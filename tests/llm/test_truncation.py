import random

import pytest

from lodestrand.llm.truncation import closing, ends_early, holds_sentence, near_copies, truncated


@pytest.mark.parametrize(("text", "verdict"), [
    ("Whole sentence. Another one.", "whole"), ("整句。另一句。", "whole"), ("First sentence is complete here. The second is cu", "ask"), ("位于泵房的围堰，每51天至少检查一次。位于罐区的安", "ask"), ("It is quite complete. Then more fol...", "cut"),
    ("Fol (...)", "cut"), ("位于罐区�", "cut"), ("| a | b |\n|---|---|\n| 1 | 2 |", "whole"), ("| a | b |\n|---|---|\n| 1 | 2", "cut"), ("| a | b |\n|---|---|\n| 1 |", "cut"), ("<s id=1>It was all done here. It is no</s>", "ask"),
    ("<s id=1>It was done.</s>", "whole"), ("It was done.</sect", "cut"), ("5.1 Scope", "ask"), ("see clause 41.", "ask dot"), ("", "whole"), ("   ", "whole"), ("It was all done here.\n***", "whole"), ("Signature: ............", "whole"),
])
def test_closings(text, verdict):
    assert closing(text)[1] == verdict


def test_lines_that_hold_sentences():
    assert holds_sentence("First sentence is complete here. The second is cu") and holds_sentence("每51天至少检查一次。位于罐区的安")
    assert not holds_sentence("4.2 Scope") and not holds_sentence("Fig. 3 shows a") and not holds_sentence("one sentence only.")


def test_alignment():
    long = "the first sentence tells one thing. the second sentence tells another thing altogether. the third ends."
    assert ends_early(long[:60], long) and ends_early("a " + long[:70], long) and not ends_early(long[:35], long) and not ends_early(long, long)


def test_corpus(spark):
    random.seed(5)
    words = "quality unit shall document every excursion batch limit lot sponsor hours finding review plan".split()
    sentence = lambda: " ".join(random.choice(words) for _ in range(9)).capitalize() + "."
    docs, cut = [], set()
    for k in range(120):
        docs.append(" ".join(sentence() for _ in range(random.randrange(3, 9))) + (f"\nRef. K{k:03d}" if k % 4 == 0 else ""))
    for k in range(20):
        base = docs[k].split("\n")[0]
        cut.add(len(docs))
        docs.append(base[: len(base) - random.randrange(3, 20)])
    for k in range(30):
        docs.append("\n".join(f"Owner: {random.choice(['sponsor', 'importer'])}\nInterval: every {random.randrange(10, 99)} weeks" for _ in range(4)) + "\nEND OF RECORD")
    for k in range(5):
        cut.add(len(docs))
        docs.append(docs[140 + k].replace("END OF RECORD", "Interv"))
    docs += ["4.2 Scope", "", None, " \n", docs[120]]
    cut.add(len(docs) - 1)
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(docs)] + [(None, "a b c", True)], "doc bigint, text string, cut boolean")
    got = {r["doc"] for r in truncated(df, "doc", "text").where("cut").collect()}
    assert got == cut


def test_near_copy_tells(spark):
    random.seed(9)
    text = " ".join(f"w{random.randrange(400)}" for _ in range(300)) + "."
    df = spark.createDataFrame([(1, text), (2, text.replace(" w1", " v1", 1)[: int(len(text) * 0.9)] + "z")], "doc bigint, text string")
    rows = {r["doc"]: r for r in truncated(df, "doc", "text").collect()}
    assert not rows[1]["cut"]
    df = spark.createDataFrame([(1, text), (2, " ".join(text.split()[:275]))], "doc bigint, text string")
    rows = {r["doc"]: r for r in truncated(df, "doc", "text").collect()}
    assert rows[2]["cut"] and rows[2]["by_copy"] and not rows[1]["cut"]


def test_longer_variants_hide_no_original(spark):
    random.seed(3)
    texts = []
    for k in range(6):
        words = [f"w{random.randrange(900)}" for _ in range(600)]
        same = " ".join(words[:589])
        texts += [(f"cut {k}", f"{same} {words[589]}"), (f"original {k}", " ".join(words) + ".")]
        texts += [(f"next {k} {v}", f"{same} a{v} b{v}.") for v in range(4)] + [(f"longest {k} {v}", same + "".join(f" {v}c{i}" for i in range(20)) + ".") for v in range(4)]
    got = {(r["_h"], r["_of"]) for r in near_copies(spark.createDataFrame(texts, "_h string, _t string")).where("early").collect()}
    assert got == {(f"cut {k}", f"original {k}") for k in range(6)}


@pytest.mark.parametrize("part", [0.1, 0.3, 0.5, 0.8])
def test_copies_cut_anywhere_are_found(spark, part):
    """Recall of near-copies, cut within a word after this part of the text, a word in sixty changed (similarity about 0.85): 0.9 or more."""
    random.seed(11)
    texts = []
    for k in range(150):
        words = [f"w{random.randrange(3000)}x" for _ in range(random.randrange(100, 400))]
        copy = words[: int(part * len(words))]
        for i in random.sample(range(len(copy) - 3), len(copy) // 60):
            copy[i] = f"v{i}"
        texts += [(f"original {k}", " ".join(words) + "."), (f"cut {k}", " ".join(copy) + " " + words[len(copy)][:2])]
    got = [(r["_h"], r["_of"]) for r in near_copies(spark.createDataFrame(texts, "_h string, _t string")).where("early").collect()]
    assert all(h.replace("cut", "original") == of for h, of in got) and len(got) >= 135


def test_empty(spark):
    assert truncated(spark.createDataFrame([], "doc bigint, text string"), "doc", "text").count() == 0
