"""Phrase collocations by the stripes pattern.

Each prefix of no, one, two or three words keys a stripe: the counts of the words that follow it. A task counts a stretch of text into stripes, stripes of a prefix are
dealt together and added place by place, and places under the least count go. What is left is one structure that answers everything: the place of a word in a stripe counts the phrase that both make,
so a prefix's own total is its place in the stripe one word shorter, and the largest place of a stripe is the most frequent extension.

Stripes are gathered by length. A phrase can be frequent only if its first and its last words, one less each, are; the frequent phrases of the length before fill a bitmap, whose size is bounded, and a task
leaves out what it does not know. A bitmap never refuses a frequent phrase; counts are exact, from the words themselves. The stripe of a frequent prefix is cut by the hash
of the next word into segments, so that none grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from .decontaminate import _bitmap
from .hashing import mix

_U = np.uint64
_STEP = _U(0xC2B2AE3D27D4EB4F)
END = b"\xff"  # a byte that UTF-8 never has stands for the end of a piece
_SIGNS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_SIGNS + b"\t" + bytes(range(65, 91)), END * len(_SIGNS) + b" " + bytes(range(97, 123)))
STRETCH = 1 << 20  # bytes of a text that are words at a time
FULL = 3_000_000  # words that a task counts at a time


class _Numbers(dict):
    """Numbers of words from 1; the end of a piece is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), _U, len(words))


def _phrase_hashes(lang: str, words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]) if words else 1, xxhash.xxh64_intdigest(lang.encode()), _U)
    for w in words:
        h = mix(h * _STEP + w)
    return h


def _known(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    mask = _U(len(bitmap) * 32 - 1)
    a, b = h & mask, (h >> _U(32)) & mask
    return (bitmap[a >> _U(5)] >> (a & _U(31)).astype(np.uint32) & 1 & (bitmap[b >> _U(5)] >> (b & _U(31)).astype(np.uint32))).astype(bool)


class _Buffer:
    """Words of one language, in order, with the ends of pieces."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, data: bytes) -> None:
        data = data.translate(_TABLE).replace(END, b" \xff ")
        at = 0
        while at < len(data):
            end = data.find(b" ", at + STRETCH)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
            at = end

    def end(self) -> None:
        self.parts.append(np.zeros(1, np.int32))

    def take(self, carry: int) -> tuple[np.ndarray, list[bytes]]:
        """All words so far; the last ``carry`` of them stay, so that phrases over the border are counted with the next ones."""
        out = np.concatenate(self.parts), list(self.numbers)
        tail = out[0][len(out[0]) - carry :] if carry else out[0][:0]
        if len(self.numbers) > 1_000_000:
            self.numbers = _Numbers()
            tail = np.array([self.numbers[out[1][k]] for k in tail], np.int32)
        self.parts, self.size = [tail], 0
        return out


def _stripes(lang: str, ids: np.ndarray, words: list[bytes], length: int, bitmap: np.ndarray | None, heavy: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch | None:
    """Stripes of the prefixes of ``length`` words: ``key, lang, prefix, nexts, counts``."""
    hashes = _word_hashes(words)
    if length:
        start = np.flatnonzero(_windows(ids > 0, length)).astype(np.int32)
        start = start[_known(_phrase_hashes(lang, [hashes[ids[start + j]] for j in range(length)]), bitmap)]
        good = np.zeros(len(ids) + 1, bool)
        good[start] = True
        start = np.flatnonzero(good[:-1] & good[1:]).astype(np.int32)  # the first and the last words of the phrase are known
    else:
        start = np.flatnonzero(ids)
    if not len(start):
        return None
    code, width = ids[start].astype(np.int64), len(words)
    top = width
    for j in range(1, length + 1):
        if top > 2**62 // width:
            code = np.unique(code, return_inverse=True)[1]
            top = int(code.max()) + 1
        code, top = code * width + ids[start + j], top * width
    _, first, counts = np.unique(code, return_index=True, return_counts=True)  # in the order of prefixes
    at = start[first]
    prefix, follow = [ids[at + j] for j in range(length)], ids[at + length]
    key = _phrase_hashes(lang, [hashes[p] for p in prefix]) if length else np.repeat(_phrase_hashes(lang, []), len(at))
    rank = np.searchsorted(heavy[0], key)
    rank[rank == len(heavy[0])] = 0
    segments = np.where(heavy[0][rank] == key, heavy[1][rank], 1).astype(_U) if len(heavy[0]) else np.ones(len(key), _U)
    key = mix(key + hashes[follow] % segments)
    order = np.lexsort((key, *prefix[::-1]))  # segments of a prefix together
    at, counts, follow, key, prefix = at[order], counts[order], follow[order], key[order], [p[order] for p in prefix]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for p in prefix:
        new[1:] |= p[1:] != p[:-1]
    bounds = np.flatnonzero(new)
    names = pa.array(words[1:], pa.binary()).cast(pa.string())  # the end of a piece, which is no UTF-8, is in no phrase
    take = lambda k: names.take(pa.array(k - 1))
    texts = pc.binary_join_element_wise(*[take(p[bounds]) for p in prefix], " ") if length else pa.array([""] * len(bounds), pa.string())
    offsets = pa.array(np.append(bounds, len(at)), pa.int32())
    columns = [pa.array(key[bounds].view(np.int64)), pa.array([lang] * len(bounds), pa.string()), texts, pa.ListArray.from_arrays(offsets, take(follow)), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "lang", "prefix", "nexts", "counts"])


def _windows(inside: np.ndarray, length: int) -> np.ndarray:
    """Where ``length`` words in a row begin."""
    out = inside.copy()
    for j in range(1, length):
        out[:-j] &= inside[j:]
        out[len(out) - j :] = False
    return out


def _count(batches: Iterator[pa.RecordBatch], length: int, held) -> Iterator[pa.RecordBatch]:
    bitmap, heavy = held.value
    buffers: dict[str, _Buffer] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, buffer in buffers.items():
            if buffer.parts:
                out = _stripes(lang, *buffer.take(length), length, bitmap, heavy)
                if out is not None:
                    yield from (out.slice(k, 2_000) for k in range(0, out.num_rows, 2_000))

    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for lang, text in zip(batch.column(1).to_pylist(), texts):
            buffer = buffers.setdefault(lang, _Buffer())
            buffer.add(text.as_py())
            buffer.end()
            if sum(b.size for b in buffers.values()) >= FULL:
                yield from flush()
    yield from flush()


def _merge(batches: Iterator[pa.RecordBatch], least: int, rest: bool) -> Iterator[pa.RecordBatch]:
    """Stripes of a prefix added place by place; only places of ``least`` or more stay, and if asked their ``rest`` under a null."""
    for table in C.whole_shards(batches, 1):
        table = table.combine_chunks()
        lists, counts = table.column("nexts").combine_chunks(), table.column("counts").combine_chunks().flatten().to_numpy()
        parent = lists.value_parent_indices().to_numpy()
        langs, prefixes, follows = (c.dictionary_encode() for c in (table.column("lang").combine_chunks(), table.column("prefix").combine_chunks(), lists.flatten()))
        owner = langs.indices.to_numpy().astype(np.int64) * len(prefixes.dictionary) + prefixes.indices.to_numpy()
        code, place = np.unique(owner[parent] * len(follows.dictionary) + follows.indices.to_numpy(), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, place, counts)
        owner, follow = np.divmod(code, len(follows.dictionary))
        lang, prefix = np.divmod(owner, len(prefixes.dictionary))
        keep = total >= least
        out = [langs.dictionary.take(pa.array(lang[keep])), prefixes.dictionary.take(pa.array(prefix[keep])), follows.dictionary.take(pa.array(follow[keep])), pa.array(total[keep])]
        yield pa.RecordBatch.from_arrays(out, names=["lang", "prefix", "next", "n"])
        if rest:
            rare = np.bincount(lang[~keep], total[~keep], len(langs.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([langs.dictionary, pa.array([""] * len(rare), pa.string()), pa.nulls(len(rare), pa.string()), pa.array(rare)], names=["lang", "prefix", "next", "n"])


def _hashed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the phrases of ``length`` words, as the counting tasks compute them."""
    for batch in batches:
        if batch.num_rows:
            words = [w for p, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) for w in [*p.split(" ")[: length - 1], f]]
            lang = np.array([xxhash.xxh64_intdigest(x.encode()) for x in batch.column(0).to_pylist()], _U)
            h = lang
            for w in _word_hashes([w.encode() for w in words]).reshape(-1, length).T:
                h = mix(h * _STEP + w)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(3)], names=["gram", "n"])


def stripes(docs: DataFrame, least: int = 30, longest: int = 4, most_bits: int = 26, segment: int = 1 << 20, text_col: str = "text", lang_col: str = "lang") -> list[DataFrame]:
    """Tables ``lang, prefix, next, n`` for prefixes of no, one, ... words: what follows a prefix ``least`` times or more inside pieces, with its count.

    The first table also has, with a null ``next``, the occurrences of all rarer words, in several rows. ``most_bits``: the bitmap of frequent phrases has at most 2 ** most_bits bits. ``segment``: a prefix
    that occurs more often than this (or than a millionth of all words, if that is more) has its stripe cut into as many segments.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("l"))
    parts, out = C.shuffle_partitions(spark), []
    none = np.zeros(0, _U)
    bitmap, heavy = None, None
    for length in range(longest):
        if heavy is None:  # the stripe of no prefix has every word of a language
            langs = [r[0] for r in texts.select("l").distinct().collect()]
            roots = np.sort(np.array([_phrase_hashes(x, [])[0] for x in langs], _U))
            heavy = roots, np.full(len(roots), 4 * parts, _U)
        held = spark.sparkContext.broadcast((bitmap, heavy))
        found = texts.mapInArrow(lambda b, k=length, h=held: _count(b, k, h), "key long, lang string, prefix string, nexts array<string>, counts array<long>")
        merged = found.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b, k=length: _merge(b, least, not k), "lang string, prefix string, next string, n long")
        out.append(C.written(merged, f"stripes-{length}"))
        frequent = out[-1].where(F.col("next").isNotNull())
        if length + 1 == longest or frequent.isEmpty():
            break
        words = out[0].agg(F.sum("n")).first()[0]
        limit = max(segment, words >> 20)  # no more than a million prefixes are above it
        grams = frequent.mapInArrow(lambda b, k=length + 1: _hashed(b, k), "gram long, n long")
        large = grams.where(F.col("n") > limit).toArrow()
        h, order = (large.column(0).to_numpy().view(_U), np.argsort(large.column(0).to_numpy().view(_U))) if large.num_rows else (none, np.zeros(0, int))
        heavy = h[order], (large.column(1).to_numpy()[order] // limit + 1).astype(_U)
        bitmap = _bitmap(grams, most_bits)
    return out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2_000, percent: int = 80, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``longest`` words of each language, ranked from 1.

    A text is cut into pieces at ``.,;:!?`` and line ends, a piece into words at spaces and tabs, A-Z in lower case. ``a`` counts a phrase inside pieces; it needs ``least``. Its score is
    floor(2,000,000 a / (l + r)) at the weakest cut, where ``l`` and ``r`` count the two parts (equal scores: the first cut); ``n`` counts the words of the language. A phrase inside a longer one
    that has ``percent`` of its occurrences or more goes. Order: score and ``a`` falling, then the phrase's bytes.
    A null language is ``und``; null and empty texts hold nothing; repeated rows all count; an empty table gives no rows. ``options`` go to ``stripes``.
    """
    tables = stripes(docs, least, longest, **options)
    spark = docs.sparkSession
    every = None
    for length, table in enumerate(tables):
        own = table.where(F.col("next").isNotNull()).select("lang", (F.concat_ws(" ", "prefix", "next") if length else F.col("next")).alias("phrase"), F.lit(length + 1).alias("len"), F.col("n").alias("a"))
        every = own if every is None else every.unionByName(own)
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = every.where("len > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1))).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("len") - F.col("k"))})
    count = lambda phrase, n: every.select("lang", F.col("phrase").alias(phrase), F.col("a").alias(n))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div cast(l + r as decimal(20, 0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase's most frequent longer one is among those of one word more, which are as frequent as any that holds them
    longer = every.where("len > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("len") - 1), part(F.lit(2), F.col("len") - 1))).alias("phrase"), F.col("a").alias("more"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(C.shuffle_partitions(spark))))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = tables[0].groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of ``documents``, of 2 to 4 words and 30 occurrences or more.

    A null language is ``und``; null and empty texts hold nothing; repeated rows count; ties go by bytes; an empty table gives no rows.
    """
    return collocations(C.read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) s(size) WHERE i + size - 1 <= len(w)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM grams WHERE f >= 30
), cuts AS (
  SELECT lang, phrase, size, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS one, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS two
  FROM frequent, (VALUES (1), (2), (3)) c(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, k, x.f AS l, y.f AS r, ((2000000 * c.f::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.one JOIN frequent y ON y.lang = c.lang AND y.phrase = c.two
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM frequent q WHERE q.lang = b.lang AND q.size > b.size AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * q.f >= 80 * b.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM held
) JOIN totals USING (lang) WHERE rank <= 2000
"""
