"""Benchmark decontamination: word-pair seeds find passages, Smith-Waterman alignment scores them.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing. The score is the best local
alignment's share of a full match (match 2, mismatch and gap -1). Seeds are pairs of words that are next to each other or have
one word between them, in item and text. They lose nothing that the score accepts: m matches and e errors score 2m - e, which
is at least 2sn for a share s of n words, so at least sn - 1 of the m - 1 steps from match to match hold one error at most, and
each such step is a pair of both. An item leaves out the commonest half of that many starts of pairs and needs the other half.
A shorter item, of which one matching word is enough, has its words as seeds.

Items are graded by the number of seeds they need, by powers of two, so that windows are as long as the items of a grade and a short
item's bound does not let windows of long ones through. The seeds' hashes fill a bitmap of at most 8 MB, and one for each grade, which is
what tasks get, whatever the benchmark's size. One pass over whole texts, vectorised over bytes, keeps windows with enough pairs that a grade's
bitmap knows; an equi-join on the pair then names the items, and window and item are aligned word by word. Items of equal words are one until
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from .hashing import pair_hashes, word_hashes

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _chunks(data: bytes, size: int = 1_000_000) -> Iterator[bytes]:
    """Cuts at a byte that is in no word; only a longer word is never cut."""
    at = 0
    while at < len(data):
        to = at + size
        while to < len(data) and _WORD[data[to]]:
            to += 1
        yield data[at:to]
        at = to


def _low(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def benchmark_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, item, item_words``: ``item`` is the same number for items of the same words; items without words are left out."""

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = [word_hashes(_low(x), _WORD)[0].view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "item_words"])

    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull())
    found = rows.mapInArrow(split, "item_id long, item_words array<long>").where(F.size("item_words") > 0)
    return C.written(found.select("item_id", F.xxhash64("item_words").alias("item"), "item_words"), "items")


def benchmark_seeds(texts: DataFrame, least_score: float) -> DataFrame:
    """``gram, item, n_words, apart, need, grade``: seeds of each distinct item, and the number of seeds that an accepted passage has."""

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.array(words, np.int64).view(_U)
                for apart in (1, 2) if least_score * len(found) > 1 else (0,):
                    out += [(g, item, start, len(found), min(apart, 1)) for start, g in enumerate(pair_hashes(found, apart).view(np.int64).tolist())]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "item", "start", "n_words", "apart"])

    rows = texts.select("item", "item_words").mapInArrow(grams, "gram long, item long, start long, n_words long, apart long")
    bound = F.when(F.col("apart") == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_words") * least_score - 1 - 1e-9))).cast("long")
    out = rows.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("gram"))).withColumn("bound", bound)
    out = out.withColumn("common", F.max("shared").over(Window.partitionBy("item", "start")))
    out = out.withColumn("rank", F.dense_rank().over(Window.partitionBy("item").orderBy(F.desc("common"), "start")))
    left = out.where(F.col("rank") > F.floor(F.col("bound") / 2)).withColumn("need", F.col("bound") - F.floor(F.col("bound") / 2))
    return C.written(left.select("gram", "item", "n_words", "apart", "need", F.floor(F.log2("need")).cast("long").alias("grade")).distinct(), "seeds")


def _bitmap(seeds: DataFrame, most_bits: int) -> np.ndarray:
    """A bit for each of two places of a seed; the bitmap has at most ``2 ** most_bits`` bits."""
    n = seeds.select("gram").distinct().count()
    bits = min(most_bits, max(16, (64 * n).bit_length()))
    places = F.explode(F.array(F.col("gram").bitwiseAND(2**bits - 1), F.shiftrightunsigned("gram", 32).bitwiseAND(2**bits - 1))).alias("at")
    words = seeds.select(places).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    out = np.zeros(2**bits // 32, np.uint32)
    found = words.toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return out


def align(region: list[list[int]], item: list[list[int]]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences (match 2, mismatch and gap -1), a batch at a time."""
    r = np.full((len(region), max(map(len, region), default=0)), -1, np.int64)
    t = np.full((len(item), max(map(len, item), default=0)), -2, np.int64)
    for k, (a, b) in enumerate(zip(region, item)):
        r[k, : len(a)], t[k, : len(b)] = a, b
    width = r.shape[1]
    slope = np.arange(1, width + 1, dtype=np.int32)
    above, best = np.zeros((len(region), width + 1), np.int32), np.zeros(len(region), np.int32)
    for k in range(t.shape[1]):
        word = t[:, k : k + 1]
        here = np.maximum(above[:, :-1] + np.where(r == word, 2, -1), above[:, 1:] - 1)
        here = np.maximum(np.maximum.accumulate(np.maximum(here, 0) + slope, axis=1) - slope, 0)
        here[(word < 0).ravel()] = 0
        best = np.maximum(best, here.max(1, initial=0))
        above[:, 1:] = here
    return best


def find_contamination(
    docs: DataFrame, items: DataFrame, least_score: float = 0.5, most_bits: int = 26, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``doc_id, text_hash, item_id, score, word_start, word_end``: the best aligned region of each document and item.

    Only scores of at least ``least_score`` are returned; ``word_start`` and ``word_end`` bound the region that was aligned.
    Null and empty texts and items match nothing; repeated rows of an id are told apart by ``text_hash`` (xxhash64 of the text)
    and equal rows give one result; a null id is kept. Items with a null id are left out; equal items under several ids each match.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    ids = benchmark_items(items, item_col, item_text_col)
    texts = ids.groupBy("item").agg(F.first("item_words").alias("item_words"))
    seeds = benchmark_seeds(texts, least_score)
    span = F.ceil(F.col("n_words") * (3 - 2 * least_score)).cast("long")  # words that a passage can span
    stats = seeds.groupBy("grade").agg(F.max(span).alias("reach"), F.min("need").alias("need"), F.min("apart").alias("least"), F.max("apart").alias("most")).collect()
    kinds_of = [apart for apart in (0, 1, 2) if any(r["least"] <= min(apart, 1) <= r["most"] for r in stats)]
    grades = [(r["grade"], r["need"], r["reach"], _bitmap(seeds.where(F.col("grade") == r["grade"]), most_bits)) for r in stats]  # no more than powers of two
    held = spark.sparkContext.broadcast((_bitmap(seeds, most_bits), grades))

    def regions(batches: Iterator) -> Iterator:
        import pyarrow as pa

        every, grades = held.value

        def known(grams: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
            mask = _U(len(bitmap) * 32 - 1)
            a, b = grams & mask, (grams >> _U(32)) & mask
            return (bitmap[a >> _U(5)] >> (a & _U(31)).astype(np.uint32) & 1 & (bitmap[b >> _U(5)] >> (b & _U(31)).astype(np.uint32))).astype(bool)

        for batch in batches:
            out = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = _low(text.as_py())
                h = [word_hashes(chunk, _WORD)[0] for chunk in _chunks(data)]
                if not h:
                    continue
                h = np.concatenate(h)
                hits = []
                for apart in kinds_of:
                    grams = pair_hashes(h, apart)
                    at = np.flatnonzero(known(grams, every))
                    hits.append((at, grams[at]))
                at, grams = (np.concatenate(x) for x in zip(*hits))
                order = np.argsort(at, kind="stable")
                places, found = at[order], grams[order]
                for grade, need, reach, bitmap in grades:
                    own = known(found, bitmap) if len(found) >= need else np.zeros(len(found), bool)
                    at, grams = places[own], found[own]
                    if len(at) < need:
                        continue
                    # windows of two reaches, a reach from each other, so that a passage lies whole in one
                    lows = np.unique(np.concatenate([at // reach, np.maximum(at // reach - 1, 0)])) * reach
                    for lo, a, b in zip(lows.tolist(), np.searchsorted(at, lows).tolist(), np.searchsorted(at, lows + 2 * reach).tolist()):
                        if b - a < need:
                            continue
                        first = np.unique(at[a:b])  # each step from match to match starts at a place of its own
                        if len(first) >= need and (first[need - 1 :] - first[: len(first) - need + 1] < reach).any():
                            hi = min(len(h), lo + 2 * reach)
                            out.append((doc, key, grade, lo, hi, h[lo:hi].astype(np.uint32).view(np.int32), grams[a:b].view(np.int64)))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text_hash", "grade", "lo", "hi", "words", "grams"])

    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col).cast("string"))
    if not kinds_of:
        rows = rows.where(F.lit(False))
    found = rows.mapInArrow(regions, "doc_id long, text_hash long, grade long, lo long, hi long, words array<int>, grams array<long>")
    found = C.written(found.withColumn("region", F.monotonically_increasing_id()), "regions")
    pairs = found.select("region", "grade", F.explode("grams").alias("gram")).join(seeds.select("gram", "grade", "item", "need"), ["gram", "grade"]).groupBy("region", "item").agg(F.count(F.lit(1)).alias("seeds"), F.first("need").alias("need"))
    pairs = pairs.where("seeds >= need").select("region", "item")
    of_item = texts.select("item", F.transform("item_words", lambda w: F.shiftright(F.shiftleft(w, 32), 32).cast("int")).alias("item_words"))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order, out = sorted(range(len(a)), key=lambda i: len(a[i])), [0.0] * len(a)
            for at in range(0, len(order), 64):
                own = order[at : at + 64]
                ids: dict[int, int] = {}
                number = lambda ws, ids=ids: [ids.setdefault(w, len(ids)) for w in ws]
                for i, s in zip(own, align([number(a[i]) for i in own], [number(b[i]) for i in own]).tolist()):
                    out[i] = s / (2 * max(1, len(b[i])))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.float64())], names=["doc_id", "text_hash", "item", "lo", "hi", "score"])

    both = pairs.join(found.drop("grams", "grade"), "region").join(of_item, "item").select("words", "item_words", "doc_id", "text_hash", "item", "lo", "hi")
    scored = both.mapInArrow(score, "doc_id long, text_hash long, item long, lo long, hi long, score double").where(F.col("score") >= least_score)
    best = F.max(F.struct("score", (-F.col("lo")).alias("back"), "hi")).alias("best")
    scored = scored.groupBy("doc_id", "text_hash", "item").agg(best).join(ids.select("item", "item_id"), "item")
    return scored.select("doc_id", "text_hash", "item_id", "best.score", (-F.col("best.back")).alias("word_start"), F.col("best.hi").alias("word_end"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item; the columns are unchanged."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = find_contamination(docs, items, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, F.col("bad_id").eqNullSafe(F.col(id_col).cast("long")) & (F.col("bad_hash") == F.xxhash64(text_col)), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Each pair of a row of ``documents`` and a row of ``benchmark`` that it holds, by the alignment's score; null and empty texts match nothing."""
    found = find_contamination(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "word_start", "word_end")
