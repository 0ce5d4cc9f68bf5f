import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import oracle
from loomspan.llm import language_model as B
from loomspan.llm import licenses, lines, quality, queries, warc


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert oracle.check(spark, con, queries.QUERIES[name], queries.ORACLES[name], SMALL) > 0


def test_lines(spark):
    rows = [(i, f"Shared footer.\nown line {i}\n", f"s{i % 9}", 1) for i in range(12)]
    rows += [(100, None, "s1", 1), (101, "", "s1", 1), (102, "\n\n", "s2", 1), (None, "Shared footer.\nlast", "s3", 1), (103, "Shared footer.", "s4", 1), (104, "few\nShared footer.\nShared footer.", None, 1), (105, "few", "s5", 1), (0, "Shared footer.\nagain", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").selectExpr("*", "'q' line", "1 h1", "2 first_doc")
    out = lines.drop_boilerplate(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted((str(r.doc_id), r.text or "", r.n_chars or 0) for r in out.collect())
    cut = lambda i, t: t if t is None or i == 0 else "\n".join(x for x in t.split("\n") if x != "Shared footer.")
    assert got == sorted((str(i), cut(i, t) or "", len(cut(i, t) or "")) for i, t, *_ in rows)
    assert lines.drop_boilerplate(docs.where("false")).count() == 0


def test_lines_near_the_threshold_are_exact(spark):
    rows = [(1000 * n + k, f"line of {n}", f"s{k}") for n in range(1, 40) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = {r.first_doc // 1000 for r in lines.boilerplate_lines(docs, min_sites=20, lg_k=4).collect()}
    near = range(16, 25)
    assert {n for n in near if n in bad} == {n for n in near if n >= 20}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["<end>"]


@pytest.mark.parametrize("head", [100_000, 30])
def test_language_model(spark, head):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(9001, None), (9002, ""), (9003, "Ünseen\x1cword \xa0 É É"), (None, "the of"), (3, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' word", "1 n", "2 row")
    out = B.class_model_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, core=30, endings=40, classes=12, head=head).orderBy("row_no").collect()
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    c = Counter(w for i, t in rows if train(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    key = lambda r: (str(r[0]), r[1], round(r[2], 3))
    want = sorted(key((i, len(words(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)))) for i, t in rows)
    assert sorted(key((r.doc_id, r.n_tokens, r.base_score)) for r in out) == want
    assert sum(r.n_known for r in out) == sum(c[w] > 0 for _, t in rows for w in words(t))
    assert {r.train_tokens for r in out} == {n}
    held = [r for r in out if r.doc_id is not None and not train(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in out)
    assert B.class_model_scores(docs.where("false"), F.lit(True)).count() == 0
    assert B.class_model_scores(docs, F.lit(False)).count() == len(rows)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    table = np.zeros((21, 21))
    a, b = range(1, 11), range(11, 21)
    for _ in range(4000):
        table[rng.choice(a), rng.choice(b)] += 1
        table[rng.choice(b), rng.choice(a)] += 1
    of = B.exchange(table, 3)
    assert len({of[i] for i in a}) == len({of[i] for i in b}) == 1 and of[1] != of[11] and of[0] == 0


@pytest.mark.parametrize("head", [100_000, 30])
def test_class_model_equals_a_plain_one(spark, head):
    """Scores from classes, counts and transitions that plain Python gathers; probabilities after any history sum to one."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(9001, None), (9002, "zzzq zzzq the")]
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"core": 30, "endings": 40, "classes": 12, "head": head}
    column = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    model, _ = B.class_model(docs, column, **options)
    of = {r.word: (r.n, r.k) for r in model.words.collect()}
    counts = Counter(w for i, t in rows if train(i) for w in words(t))
    counts[""] = counts.pop("<end>")
    assert {w: n for w, (n, _) in of.items()} == counts
    kind = lambda w: of[w][1] if w in of else model.endings.get(w[-3:], model.usual)
    path = lambda t: [0, *(kind(w) for w in words(t)[:-1]), 0]
    size = len(model.mass)
    table = np.zeros((size, size))
    for i, t in rows:
        if train(i):
            for a, b in zip(path(t), path(t)[1:]):
                table[a, b] += 1
    share = (table.sum(0) + 0.1) / (table.sum() + 0.1 * size)
    steps = (table + 5 * share) / (table.sum(1, keepdims=True) + 5)
    assert np.allclose(10**model.steps, steps) and np.allclose(steps.sum(1), 1)
    held = [[n for w, (n, k) in of.items() if w and k == c] for c in range(size)]
    cut = [min(0.95, max(0.05, (h.count(1) + 0.5) / (h.count(1) + 2 * h.count(2) + 1))) for h in held]
    emit = lambda w: 1.0 if not w else (of[w][0] - cut[kind(w)]) / sum(held[kind(w)]) if w in of else cut[kind(w)] * len(held[kind(w)]) / sum(held[kind(w)])
    for c in range(1, size):
        if held[c]:
            assert math.isclose(sum(emit(w) for w, (_, k) in of.items() if w and k == c) + cut[c] * len(held[c]) / sum(held[c]), 1)
    want = {i: sum(math.log10(steps[a, b]) for a, b in zip(path(t), path(t)[1:])) + sum(math.log10(emit(w)) for w in words(t)[:-1]) for i, t in rows}
    got = {r.doc_id: r.score for r in B.class_model_scores(docs, column, **options).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_a_word_moves_to_the_class_of_its_contexts():
    rng = np.random.default_rng(3)
    table = rng.integers(50, 100, (6, 6)).astype(float)
    table[2, 3] = table[3, 2] = 5000  # classes 2 and 3 alternate
    table[1] += 400
    table[:, 1] += 400
    slots, n = np.array([2, 6 + 2, 3, 6 + 3, 4]), np.array([40.0, 40, 30, 30, 1])
    assert B.best_classes(slots, n, np.array([0, 2]), table).tolist() == [3, 2]


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = queries.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (7, ""), (7, " "), (8, "x " * 60_000)], "doc_id long, text string")).selectExpr("*", "1 score", "'b' x")
    model = quality.fit_quality(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 7, 0)], labels.schema)), sample=150)
    assert quality.quality_scores(more, model).count() == more.count()
    kept = quality.keep_quality(more, model)
    assert kept.columns == more.columns and 0.7 * more.count() < kept.count() < more.count()
    assert quality.quality_scores(more.where("false"), model).count() == 0
    none = quality.fit_quality(docs, labels.where("false"))
    assert {r.score for r in quality.quality_scores(more, none).collect()} == {0.5}


def test_word_vectors_equal_sums_over_all_documents(spark):
    texts = ["The cat saw the dog", "a CAT saw a cat", None, "", "dog", "the the the " * 30]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), held_tokens=7)
    words = sorted({w.lower() for t in texts if t for w in t.split()}, key=quality.word_hash)
    assert got.words.tolist() == [quality.word_hash(w) for w in words]
    index = {w: quality.index_vectors(np.array([quality.word_hash(w)], np.uint64))[0] for w in words}
    assert all((np.abs(v).reshape(8, 4).sum(1) == 1).all() for v in index.values())
    want = {w: np.zeros(quality.DIM) for w in words}
    for t in texts:
        split = (t or "").lower().split()
        for a, b in zip(split, split[1:]):
            want[a] += index[b]
    table = np.array([want[w] for w in words])
    table -= table.sum(0) / np.abs(table).sum() * np.abs(table).sum(1, keepdims=True)
    table *= np.sqrt(8) / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got.contexts, table, atol=1e-5)
    hashes = np.array([quality.word_hash(w) for w in ("CAT", "never")], np.uint64)
    assert np.allclose(got.of(hashes)[0], index["cat"] + table[words.index("cat")], atol=1e-5) and (got.of(hashes)[1] == quality.index_vectors(hashes[1:])[0]).all()
    assert len(quality.word_vectors(spark.createDataFrame([], "text string")).words) == 0


def test_pooled_vector_of_a_long_text_does_not_depend_on_blocks(spark):
    vectors = quality.word_vectors(spark.createDataFrame([("one two three four " * 50,)], "text string"))
    tokens = quality._Tokens(vectors)
    words = [f"w{i % 700}" for i in range(5_000)]
    x, empty, null, short = quality.pool([" ".join(words), "", None, "one two one"], 4, tokens)
    each = vectors.of(np.array([quality.word_hash(w) for w in words], np.uint64))
    assert np.allclose(x[: quality.DIM], each.mean(0), atol=1e-4) and not empty.any() and not null.any()
    assert np.allclose(x[2 * quality.DIM + 1 :], [(4 * 700 + 700) / 5_000, 0, 5 / 5_000, len(" ".join(words)) / 100_000], atol=1e-6)
    assert np.allclose(short[2 * quality.DIM :], [np.log(4) / 8, 2 / 3, 0, 1 / 3, 11 / 60], atol=1e-6)
    tokens.trim(0)
    assert np.allclose(quality.pool([" ".join(words)], 1, tokens, group=1), [x])


def test_temperature_is_fitted_on_rows_that_the_weights_did_not_see():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    net = quality.Network.fit(x, y)
    p = net.probability(rng.normal(size=(2000, 4)))
    assert 0.25 < net.temperature < 8 and 0 < p.min() < p.max() < 1


STATED = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved."}


def test_licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit_licences(spark)
    got = {(r.doc_id, r.family) for r in licenses.scan_licences(docs, model).collect()}
    want = {(r.doc_id, f) for r in docs.collect() for f, p in STATED.items() if p in r.text}
    assert got == want
    rows = [(1, "Released under the Foo Bar License, version 9."), (2, "some\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\nx"), (3, "nothing here"), (4, None), (5, ""), (None, "SPDX-License-Identifier: MIT"), (6, "the cat sat"), (7, "All rights reserved.\nall rights RESERVED"), (8, "word " * 30_000)]
    own = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 para", "2 family", "3 n")
    got = {(r.doc_id, r.family, r.paragraphs) for r in licenses.scan_licences(own, model).collect()}
    assert got == {(1, "unknown", 1), (2, "mit", 1), (None, "mit", 1), (7, "proprietary", 2)}
    assert licenses.scan_licences(own.where("false"), model).count() == 0
    planted = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("\nLicensed under the W"), F.col("doc_id").cast("string"), F.lit(" License."))).otherwise(F.col("text")).alias("text"))
    got = {(r.doc_id, r.family) for r in licenses.scan_licences(planted, model).collect()}
    ids = [r.doc_id for r in docs.collect() if r.doc_id % 3 == 0]
    assert sum((i, "unknown") in got for i in ids) >= 0.95 * len(ids) and {x for x in got if x[1] != "unknown"} == want and all(i % 3 == 0 for i, f in got if f == "unknown")


WRAPPED = {
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0""",
    "mpl-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def test_wrapped_notices(spark):
    rows = [(k, f"code of some kind\n\n{t}\n\nint main") for k, t in enumerate(WRAPPED.values())] + [(9, "Copyright (c) 2020 Some Body"), (10, "they gave permission to build the public road"), (11, "Released under the MIT License.\nReleased under the Zork License.")]
    got = {(r.doc_id, r.family) for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), licenses.fit_licences(spark)).collect()}
    assert got == set(enumerate(WRAPPED)) | {(11, "mit"), (11, "unknown")}


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "n", big), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 90), (2, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 first", "'p' payload", "3 sha1")
    for options in ({}, {"compression": "none"}):
        path = f"file://{tmp_path}/warc-{len(options)}"
        warc.register(spark)
        if options:
            first = spark.read.format("warc").load(f"file://{tmp_path}/warc-0").withColumn("payload_length", F.col("http_headers")["content-length"])
            first.select("record_type", "record_id", "target_uri", "payload", "payload_digest", "refers_to", "payload_length").write.format("warc").mode("append").options(**options).save(path)
        else:
            warc.write_pages(pages, path)
        got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_pages(spark, path).collect())
        assert got == sorted([("1", 1400, "revisit", 2), ("2", 1400, "response", None), ("2", 1400, "response", None), ("3", 5, "response", None), ("4", 5, "response", None), ("5", 0, "response", None), ("6", 1350, "response", None), ("None", 1400, "revisit", 2)])
        bodies = {r.record_id: bytes(r.payload) for r in spark.read.format("warc").load(path).where("record_type = 'response'").collect()}
        assert bodies["<urn:page:2>"] == big.encode() and bodies["<urn:page:6>"].decode() == rows[6][2]
        some = spark.read.format("warc").load(path).where("target_uri IN ('u', 'n') AND record_type = 'response' AND content_length > 0")
        assert some.count() == 4 and "target_uri" in some._jdf.queryExecution().toString()
    reader = warc.WarcReader({"path": f"file://{tmp_path}/warc-0", "payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 1)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_warc_reads_members_without_lengths(spark, tmp_path):
    import gzip

    data = b"".join(gzip.compress(warc.record_bytes({"record_type": t, "record_id": f"<r{k}>", "payload": b"x" * 20_000})) for k, t in enumerate(("warcinfo", "response", "resource")))
    (tmp_path / "a.warc.gz").write_bytes(data)
    warc.register(spark)
    got = {r.record_id: len(r.payload) for r in spark.read.format("warc").load(f"file://{tmp_path}").collect()}
    assert got == {"<r0>": 20_000, "<r1>": 20_000, "<r2>": 20_000}
    assert spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}").where("record_type = 'resource'").count() == 1


def test_warc_of_an_empty_table(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_pages(spark, f"file://{tmp_path}/none").count() == 0
