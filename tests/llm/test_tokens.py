import random
import struct
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspan.llm import packing, token_output
from loomspan.llm.tokens import TextEncoder

PIECES = ["a", "b", "The", "é", "ß", "'s", "'", "!", ".", " ", "  ", "\n", "\n\n", "\t", "1", "²", "x́", "́", "日本", "don't", "***", "-", "_", "Σ", "<|endoftext|>", "\r\n", "\x1c", "ﬁ", "İ", " "]
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    rng = random.Random(1)
    enc, plain = TextEncoder(path, keep=50), Tokenizer.from_file(path)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [f"x{chr(c)}y {chr(c)} A{chr(c)}." for c in range(0xA0, 0x250)] + ["word " * 3000]
    for t in texts:
        assert enc.ids(t) == array("I", plain.encode(t, add_special_tokens=False).ids).tobytes(), repr(t)


def test_elias_fano_round_trip_and_select():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5], [0, 0, 0, 7], rng.integers(0, 50, 3000).cumsum(), rng.integers(0, 2**20, 900).cumsum(), np.zeros(600, int)):
        v = np.asarray(values, dtype=np.uint64)
        e = token_output.EliasFano.encode(v)
        assert (e.decode() == v).all()
        assert all(e.select(i) == v[i] for i in range(0, len(v), 37))
    big = token_output.EliasFano.encode(rng.integers(0, 1000, 20_000).cumsum())
    assert len(big.low) + 8 * len(big.high) + 4 * len(big.samples) < 20_000 * 2  # under 16 bits a document


ROWS = [(3, "Hello there, world."), (1, ""), (2, None), (None, "no id"), (3, "Hello there, world."), (9, "x " * 5000), (-4, "minus")]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'s' part", "1 length", "2 piece", "3 start", "4 sequence_id")  # clashing names


def expected(path, rows, end):
    t = Tokenizer.from_file(path)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in rows]


def test_token_files_round_trip(spark, tmp_path):
    want = sorted(((i is not None, i or 0, ids) for i, ids in expected(BYTE, ROWS, 2)), key=lambda x: x[:2])
    manifest = token_output.write_token_ids(docs(spark), f"file://{tmp_path}/ids", BYTE, segment_tokens=100)
    got = sorted(token_output.read_token_ids(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in want]
    assert [r.ids for r in got] == [ids for *_, ids in want]
    assert [r.start for r in got] == np.cumsum([0] + [len(ids) for *_, ids in want])[:-1].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) for *_, ids in want]
    s = token_output.Segment(token_output.get_file(manifest.where("n_docs > 1").first().file)) if manifest.where("n_docs > 1").count() else None
    assert s is None or s.ids(1).tolist() in [ids for *_, ids in want]
    assert manifest.count() > 1


def test_token_files_of_an_empty_table(spark, tmp_path):
    manifest = token_output.write_token_ids(docs(spark).where("false"), f"file://{tmp_path}/none", BYTE)
    assert token_output.read_token_ids(manifest).count() == 0


def test_packing_is_exact(spark):
    got = packing.pack(docs(spark), WORD, capacity=64).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 64
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    want = []
    for i, ids in expected(WORD, ROWS, 1):
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(array("I", ids[k : k + 64]).tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: tuple(-(10**9) if x is None or x != x else x for x in r)
    mine = [tuple(r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(key, mine)) == sorted(map(key, want))


def test_packing_of_an_empty_table(spark):
    assert packing.pack(docs(spark).where("false"), WORD).count() == 0


def test_best_two_fit_uses_every_piece_and_few_bins():
    rng = np.random.default_rng(3)
    for capacity in (10, 64, 4096):
        sizes = np.minimum(rng.geometric(8 / capacity, 5000), capacity)
        counts = np.bincount(sizes, minlength=capacity + 1)
        plan = packing.best_two_fit(counts)
        used = np.zeros(capacity + 1, int)
        for repeats, uses in plan:
            assert sum(n * k for n, k in uses) <= capacity
            for n, k in uses:
                used[n] += n and k * repeats
        assert (used == counts).all()
        assert sum(r for r, _ in plan) <= -(-int(sizes.sum()) // capacity) * 1.02 + 1


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves a gap of 1; 3 is replaced with 2 + 2
    assert packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11))[0] == (1, [(6, 1), (2, 2)])
