import re
from collections import Counter, defaultdict

import pytest

import oracle
from conftest import SMALL
from pyspark.sql import functions as F

from loomspan.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def check(rows, got, **how):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    targets = plain_targets(sizes, **how)
    assert Counter((r.id, r.size, r.source_size, round(r.target, 6)) for r in got) == Counter((i, size(t), sizes[s], round(targets[s], 6)) for i, t, s in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    source, taken = {i: s for i, _, s in rows}, Counter()
    for r in got:
        taken[source[r.id]] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in targets.items())
    partial = Counter(source[r.id] for r in got if r.size and r.taken % r.size)
    assert all(n == 1 for n in partial.values())
    return targets, sizes


def rows_of(n, seed=0):
    import random

    rng = random.Random(seed)
    sources = ["src0"] * 12 + ["src10", "src2", "Ä", "a", "Z", None, "tiny", "empty"]
    out = []
    for i in range(n):
        s = rng.choice(sources)
        k = 0 if s == "empty" else 1 if s == "tiny" else rng.choice([1, 5, 30, 400])
        out.append((i, " ".join(["w"] * k) + "\t\n", s))
    return out


@pytest.mark.parametrize("slot_rows", [10_000, 10, 1])
def test_targets_are_met_to_the_word(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(M, "SLOT_ROWS", slot_rows)
    rows = rows_of(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 size", "2 key", "3 u", "4 class")
    check(rows, M.mix(docs.repartition(5)).collect())


def test_slots_do_not_change_the_result(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(300, 1), "doc_id long, text string, source string")
    want = sorted(M.mix(docs).collect(), key=str)
    monkeypatch.setattr(M, "SLOT_ROWS", 3)
    assert sorted(M.mix(docs.repartition(7)).collect(), key=str) == want


def test_query_equals_sql(spark):
    con = oracle.connect(SMALL)
    assert oracle.check(spark, con, M.op11_mixing, M.OP11_SQL, SMALL) > 0


def test_inclusion_follows_the_odds(spark):
    """Over many seeds, documents of a weight are read as often as their copies say."""
    rows = [(i, "w " * 10, "a" if i < 40 else "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 4 == 0, 3.0).otherwise(1.0)
    taken, runs = Counter(), 12
    for seed in range(runs):
        for r in M.mix(docs, weights=(1, 4), seed=seed, weight=weight).collect():
            taken[r.id] += r.taken
    heavy, light = (sum(taken[i] for i in range(40) if (i % 4 == 0) == h) / (10 if h else 30) / 10 / runs for h in (True, False))
    assert abs(heavy * 10 + light * 30 - 12) < 0.5  # a target of 120 words: the expected copies are 0.6 and 0.2
    assert abs(heavy - 0.6) < 0.12 and abs(light - 0.2) < 0.05


def test_weights_within_the_cap(spark):
    rows = [("a", 100.0, 10, 90.0), ("a", 1.0, 80, 90.0), ("a", 0.0, 5, 90.0), ("b", 2.0, 10, 30.0), ("b", 1.0, 10, 30.0), ("c", 0.0, 4, 0.0)]
    got = defaultdict(dict)
    for r in M.expected_copies(spark.createDataFrame(rows, "source string, weight double, words long, target double"), "source").collect():
        got[r.source][r.weight] = r.copies
    assert got["a"][100.0] == 3 and abs(got["a"][1.0] - 60 / 80) < 1e-9 and got["a"][0.0] == 0
    assert abs(got["b"][2.0] * 10 + got["b"][1.0] * 10 - 30) < 1e-9 and abs(got["b"][2.0] - 2 * got["b"][1.0]) < 1e-9
    assert got["c"][0.0] in (0.0, 3.0)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, "a b c", None), (None, "a b c", None), (1, None, "s"), (2, "", "s"), (3, "one two", "s"), (3, "one two", "s"), (3, "one two three", "s"), (4, "w " * 3000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(M.mix(docs).collect(), key=str)
    assert len(first) == len(rows) and first == sorted(M.mix(docs.repartition(3)).collect(), key=str)
    assert sum(r.taken for r in first) in range(3010, 3020)
    assert M.mix(docs.where("false")).count() == 0
    assert {(r.size, r.target, r.taken) for r in M.mix(docs.where("text is null or text = ''")).collect()} == {(0, 0.0, 0)}


def test_a_giant_document(spark):
    rows = [(0, "w " * 20000, "big"), (1, "w", "big"), (2, "w " * 30000, "other")]
    check(rows, M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
