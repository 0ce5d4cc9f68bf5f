from collections import Counter

import corpus_pipeline as P
from conftest import SMALL

from loomspan.llm import _common as C


def test_stages(spark):
    docs = C.read(spark, SMALL, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in C.read(spark, SMALL, "labels").collect()}
    items = [r.text.lower() for r in C.read(spark, SMALL, "benchmark").collect()]
    kept = {}
    for name, stage in P.STAGES:
        docs = C.written(stage(spark, docs, SMALL), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept["quality"] for i in good) >= 0.95 * len(good)
    assert sum(i in kept["quality"] for i, q in labels.items() if q == 0) <= 0.3 * max(1, sum(q == 0 for q in labels.values()))
    assert set(kept["lines"]) == set(kept["quality"])
    assert set(kept["near_duplicates"]) <= set(kept["lines"])
    texts = Counter(kept["near_duplicates"].values())
    assert max(texts.values()) == 1
    left = kept["decontaminate"]
    assert not any(x in t.lower() for t in left.values() for x in items)
    assert set(kept["near_duplicates"]) - set(left) == {i for i, t in kept["near_duplicates"].items() if any(x in t.lower() for x in items)}
    packed = docs.toPandas()
    assert set(packed["doc_id"]) == set(left) and packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert set(before) >= set(left)


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(4, text, "en", "s", 1), (4, text, "en", "s", 1), (2, text + " end", "en", "s", 1), (None, "solo", "en", "s", 1), (7, "different words in this text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str(r.doc_id) for r in P.near_duplicates(spark, docs, "").collect())
    assert got in (["2", "7", "None"], ["2", "4", "7", "None"])


def test_near_duplicates_keep_other_texts_of_a_repeated_id(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(50))
    rows = [(k, text(f"a{k}") + " end") for k in range(10)]
    for k in range(10):
        rows += [(100 + k, text(f"a{k}")), (100 + k, text(f"b{k}")), (100 + k, text(f"c{k}")), (100 + k, text(f"c{k}")), (100 + k, text(f"c{k}").upper())]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text.lower()) for r in P.near_duplicates(spark, docs, "").collect())
    want = [(k, text(f"a{k}") + " end") for k in range(10)] + [(100 + k, text(f"{c}{k}")) for k in range(10) for c in "bc"]
    assert got == Counter(want)


def test_an_empty_corpus(spark):
    docs = C.read(spark, SMALL, "documents").where("false")
    for _, stage in P.STAGES:
        docs = C.written(stage(spark, docs, SMALL), "empty")
    assert docs.count() == 0
