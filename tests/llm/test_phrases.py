import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SMALL

import oracle
from loomspan.llm import phrases as P


def plain(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        frequent = {p: a for p, a in counts.items() if a >= least}
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in frequent.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "Ünï", "x\x00y", "a b", "\x1c", "日本", "end"]
    text = lambda: "".join(rng.choice(words[:6] if rng.random() < 0.5 else words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", "; "]) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "en", "de", None, "und", "zz"]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]


def got(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").selectExpr("*", "1 n", "2 phrase", "3 l", "'x' key")
    out = P.collocations(docs.repartition(3), **how)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("how", [{}, {"segment": 5}, {"most_bits": 5}, {"full": 50, "stretch": 7}])
def test_equals_a_plain_count(spark, monkeypatch, how):
    rows = rows_of(250, 1) + [("en", "New York City " * 40), ("en", "new york city hall, " * 50)]
    if "full" in how:  # many small stretches of a text; tasks that count a few words at a time
        monkeypatch.setattr(P, "FULL", how["full"])
        monkeypatch.setattr(P, "STRETCH", how["stretch"])
        how = {}
    want = plain(rows, 6)
    assert len(want) > 30 and got(spark, rows, least=6, **how) == want


def test_first_phrases_only(spark):
    rows = rows_of(200, 2)
    assert got(spark, rows, least=4, top=7) == plain(rows, 4, 7)


def test_long_texts_and_many_words(spark):
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60_000))), ("en", "same " * 20_000)]
    assert got(spark, rows, least=5) == plain(rows, 5)


def test_nothing_to_find(spark):
    assert got(spark, [("en", None), (None, ""), ("de", "one two. three")], least=2) == []
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_query_equals_sql(spark):
    con = oracle.connect(SMALL)
    assert oracle.check(spark, con, P.op12_phrases, P.OP12_SQL, SMALL) > 0
