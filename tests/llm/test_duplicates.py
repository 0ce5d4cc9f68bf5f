import random
import re

import numpy as np
import pytest
from conftest import SMALL

from loomspan.llm import _common as C
from loomspan.llm import decontaminate as D
from loomspan.llm import embeddings as V
from loomspan.llm import simhash as S


def components(adjacent):
    label = np.arange(len(adjacent))
    while True:
        new = np.array([min(label[i], label[adjacent[i]].min(initial=len(label))) for i in range(len(label))])
        if (new == label).all():
            return label
        label = new


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", "É", " ", "\n", "\t", "\x0b", "\xa0", "\x1c", "cat", "."]) for _ in range(rng.randint(0, 60)))
        assert S.fingerprint(t) == slow_fingerprint(t), repr(t)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0


@pytest.mark.parametrize("sizes", [{}, {"leaf": 40}, {"leaf": 40, "block": 15}])
def test_links_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(2)
    points = [0, 1, 3, 2**64 - 1]
    for b in rng.integers(0, 2**64, 60, dtype=np.uint64):
        x = int(b)
        for _ in range(8):
            points.append(x)
            for _ in range(rng.integers(1, 6)):
                x ^= 1 << int(rng.integers(0, 64))
    u = np.unique(np.array(points, dtype=np.uint64))
    want = components(np.bitwise_count(u[:, None] ^ u[None]) <= 4)
    df = spark.createDataFrame([(int(v),) for v in u.view(np.int64)], "fp long")
    root = {r.fp: r.root for r in S.hamming_components(df, 4, **sizes).collect()}
    got = [root.get(int(v), int(v)) for v in u.view(np.int64)]
    assert len({(a, b) for a, b in zip(want, got)}) == len(set(want)) == len(set(got))


def test_simhash_rows(spark):
    rows = [(5, "one two three four five"), (2, "One TWO three four five"), (9, None), (8, ""), (7, " \n\t"), (None, "other words here now"), (5, "one two three four five"), (1, "lone " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' fp", "0 root", "1 least")
    got = S.simhash_groups(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert {c for _, c in by[5] | by[2]} == {2} and len(by[5] | by[2]) == 1
    assert by[9] == by[8] == by[7] == {("0" * 16, 7)} and {c for _, c in by[None]} == {None}
    assert S.simhash_groups(df.where("false")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[100 + k] for k in range(30)}) == 1 and got[200] == got[201]
    assert len(set(got.values())) == 3
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, cosine=0.98):
    n = len(rows)
    ok = [r[1] is not None and bool(r[2]) and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    a = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                x, y = np.array(rows[i][2], float), np.array(rows[j][2], float)
                a[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    label = components(a)
    least = {c: min(rows[i][0] for i in range(n) if label[i] == c) for c in set(label)}
    return sorted((rows[i][0], int(a[i].sum()), least[label[i]], rows[i][0] == least[label[i]]) for i in range(n))


@pytest.mark.parametrize("options", [{}, {"block": 4}, {"tables": 6, "probes": 2}])
def test_embedding_links_equal_brute_force(spark, options):
    rng, rows = np.random.default_rng(3), []
    for c in range(12):
        x = rng.normal(size=16)
        for _ in range(9):
            rows.append((len(rows), int(c % 3), [float(v) for v in x + rng.normal(size=16) * 0.08 * rng.random()]))
        for y, label in ((x * 2, int(c % 3)), (x, None), (x, int(c % 3)), (x, int(c % 3))):
            rows.append((len(rows), label, [float(v) for v in y]))
    rows += [(900, 1, None), (901, 1, [0.0] * 16), (902, 1, [float("nan")] + [1.0] * 15), (903, 1, [None] + [1.0] * 15), (904, 1, []), (905, 1, [float("inf")] * 16), (906, 1, [1.0, 0.0]), (907, 1, [1e-30, 0.0]), (908, 1, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 cls", "'a' bucket", "2 v")
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.embedding_duplicates(df, **options).collect())
    want = brute_vectors(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and found <= there and found >= 0.9 * there
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)
    assert V.embedding_duplicates(df.where("false")).count() == 0


def test_embedding_recall_over_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in df.where("vec_id < 250").collect()]
    near = [(10_000 + r[0], r[1], [v + 0.001 for v in r[2]]) for r in rows]
    got = V.embedding_duplicates(spark.createDataFrame(rows + near, "vec_id long, label int, embedding array<float>"))
    linked = sum(r.n_links > 0 for r in got.collect())
    assert linked >= 0.99 * len(rows + near)


@pytest.mark.parametrize("dim", [16, 64, 256, 768])
def test_embedding_recall_at_the_threshold(spark, dim):
    """Isolated pairs at a cosine just above 0.98 are found, those just below are not."""
    rng, rows = np.random.default_rng(dim), []
    for k in range(300):
        x, y = rng.normal(size=(2, dim))
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        c = 0.9801 if k % 2 else 0.9799
        rows += [(2 * k, 1, [float(a) for a in x]), (2 * k + 1, 1, [float(a) for a in c * x + np.sqrt(1 - c * c) * y])]
    got = {r.vec_id: r.n_links for r in V.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert sum(got[4 * k + 2] for k in range(150)) >= 0.99 * 150 and not any(got[4 * k] for k in range(150))


def slow_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("mean", [0.5, 0.7])
def test_vectors_with_a_common_mean(spark, mean):
    """Isolated pairs at a cosine of 0.9801 are found, and vectors that only share a mean are hardly ever measured against each other."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=64)
    m /= np.linalg.norm(m)
    rows = rng.normal(size=(900, 64))
    rows -= (rows @ m)[:, None] * m
    rows = np.sqrt(mean) * m + np.sqrt(1 - mean) * rows / np.linalg.norm(rows, axis=1, keepdims=True)
    aside = rng.normal(size=(300, 64))
    aside -= (aside * rows[:300]).sum(1, keepdims=True) * rows[:300]
    pairs = 0.9801 * rows[:300] + np.sqrt(1 - 0.9801**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    every = np.concatenate([rows, pairs])
    near = V.sketches(every).view("u1")
    apart = np.array([np.bitwise_count(near ^ x).sum(1) for x in near])
    alike = (apart <= V.APART) & ~np.eye(len(every), dtype=bool)
    assert alike[:300, 900:].diagonal().mean() > 0.995
    alike[np.arange(300), 900 + np.arange(300)] = alike[900 + np.arange(300), np.arange(300)] = False
    assert alike.mean() < 1e-3
    got = V.embedding_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")).collect()
    found = {r.vec_id: r for r in got}
    cos = every @ every.T
    np.fill_diagonal(cos, 0)
    assert all(r.n_links <= (cos[i] >= 0.98).sum() for i, r in found.items())
    assert sum(found[900 + i].component_id == found[i].component_id for i in range(300)) >= 0.99 * 300


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(4)
    a, b = ([[rng.randint(0, 4) for _ in range(rng.randint(1, n))] for _ in range(80)] for n in (30, 12))
    assert D.align(a, b).tolist() == [slow_alignment(x, y) for x, y in zip(a, b)]


def test_contamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)] + [(50, None), (51, ""), (52, "tiny"), (None, "null id item text")]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for k in range(20):
        w = items[k][1].split()
        edited = []
        for x in w:
            u = rng.random()
            edited += [word()] if u < 0.08 else [] if u < 0.12 else [x, word()] if u < 0.16 else [x]
        rows += [(k, f"{noise(40)} {items[k][1].upper()}, {noise(300)}"), (100 + k, noise(50) + "\n" + " ".join(edited) + "! " + noise(20)), (200 + k, noise(200))]
        want |= {(k, k), (100 + k, k)}
    rows += [(300, None), (301, ""), (None, items[3][1]), (302, "a tiny thing"), (303, ("x" * 50 + " ") * 40_000 + items[5][1]), (0, noise(50))]
    want |= {(None, 3), (302, 52), (303, 5)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 item_id", "2 score", "'z' words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score == 1.0 for r in got if r.doc_id is not None and r.doc_id < 20)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted([0, *range(200, 220), 300, 301])
    assert D.find_contamination(docs.where("false"), bench).count() == D.find_contamination(docs, bench.where("false")).count() == 0


def test_wide_fingerprints_group_similar_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows, base = [], {}
    for g in range(40):
        words = [word() for _ in range(300)]
        for c in range(4):
            own = list(words)
            for k in rng.sample(range(300), 4 * (c > 0)):
                own[k] = word()
            rows.append((10 * g + c, " ".join(own) if c % 2 else " ".join(own).upper()))
            base[10 * g + c] = 10 * g
    rows += [(9001, None), (9000, ""), (9002, " \n"), (None, "a null id"), (7, "repeated row"), (7, "repeated row"), (9100, "word " * 30_000)]
    shingles = {i: {" ".join(t.lower().split()[k : k + 5]) for k in range(296)} for i, t in rows[:160]}
    similar = [(a, b) for a in base for b in base if a < b and base[a] == base[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert len(similar) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 node", "'f' f0", "2 least")
    for sizes in ({}, {"leaf": 20, "block": 6}):
        got = S.near_duplicate_groups(docs, **sizes).collect()
        assert len(got) == len(rows)
        group = {r.doc_id: r.component_id for r in got}
        assert sum(group[a] == group[b] for a, b in similar) >= 0.98 * len(similar)
        assert all(base[i] == base[group[i]] for i in base)
        assert group[9000] == group[9001] == group[9002] == 9000 and group[None] is None and group[7] == 7
    assert S.near_duplicate_groups(docs.where("false")).count() == 0


def test_near_duplicate_links_are_measured(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    rows = []
    for g in range(600):  # isolated pairs: six changed words leave a Jaccard of 266 / 326, seven leave 261 / 331
        words = [word() for _ in range(300)]
        own = list(words)
        for k in range(6 + g % 2):
            own[20 + 40 * k] = word() + "z"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in S.near_duplicate_groups(docs).collect()}
    linked = [group[2 * g] == group[2 * g + 1] for g in range(600)]
    assert sum(linked[::2]) >= 0.97 * 300 and not any(linked[1::2])


def test_groups_with_refused_links_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    texts = []
    for _ in range(12):  # chains of edits: neighbours above and below the limit
        own = [word() for _ in range(120)]
        for _ in range(12):
            own = list(own)
            for k in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
                own[k] = word()
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    want = components(np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ({}, {"leaf": 20, "block": 6, "torn_block": 4}):
        group = {r.doc_id: r.component_id for r in S.near_duplicate_groups(docs, **sizes).collect()}
        assert sum(group[i] == want[i] for i in range(len(texts))) >= 0.97 * len(texts)
        assert len({(int(want[i]), group[i]) for i in range(len(texts))}) <= len(set(want.tolist())) + 4


def test_contamination_finds_what_the_score_accepts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8)))
    shared = [word() for _ in range(40)]
    items = [(k, " ".join(shared)) for k in range(6)]  # equal items
    items += [(10 + k, " ".join([*shared[:36], word(), word()])) for k in range(6)]  # and templated ones
    short = [[word() for _ in range(15)] for _ in range(20)]
    items += [(100 + k, " ".join(w)) for k, w in enumerate(short)] + [(200, "alpha beta gamma"), (201, "delta epsilon")]
    edits = lambda w, every: [word() if (i + 1) % every == 0 else x for i, x in enumerate(w)]
    texts = [edits(shared, 4) for _ in range(10)] + [edits(shared, 3) for _ in range(10)]
    for w in short:
        texts += [[word() if i in (2, 5, 8, 11) else x for i, x in enumerate(w)], edits(w, 3), edits(w, 2), [y for x in w for y in (x, word())]]
    texts += [["alpha", word(), "gamma"], ["delta", word()], ["gamma", word()]]
    rows = [(k, " ".join([*(word() for _ in range(rng.randint(0, 200))), *t, *(word() for _ in range(60))])) for k, t in enumerate(texts)]
    number: dict[str, int] = {}
    of = {k: [number.setdefault(x, len(number)) for x in t.split()] for k, t in items}
    want = {(d, k): slow_alignment([number.get(x, -1) for x in t.split()], w) / (2 * len(w)) for d, t in rows for k, w in of.items()}
    want = {pair: score for pair, score in want.items() if score >= 0.5}
    got = D.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(want) > 200
