"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

A word is a token in lower case. Its index vector is sparse, random and made from the word's hash, so that any word has one
without a table. A word's context vector is the sum of the index vectors of the words that follow it, over all documents;
every word that makes up at least 1 / ``SHARE`` of all tokens has one, which no more than ``SHARE`` words can. A first pass counts all
words, a second sums contexts inside tasks and emits one small vector a word; Spark adds them. The vector of a word is its index vector
and, if it has one, its context vector scaled to the same length.

Shapes (patterns of capitals, letters, digits and other characters) are treated alike, but for their index vectors, which belong to
hash buckets. A document is the mean of its tokens' vectors and a few plain ratios.

Only the network is fitted on a sample: at most ``sample`` labelled rows, chosen by hash. One in five of these is kept from
the weights and sets the temperature, so scores are calibrated probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

SHARE, SHAPES, DIM = 100_000, 512, 32
BLOCK = 1024  # words at a time whose distinct ones are counted, so that the ratio does not fall with length
_CAPITALS, _LETTERS, _DIGITS, _SAME = (re.compile(p) for p in (r"[A-Z\u00c0-\u00de]{2,}", r"[a-z\u00df-\uffff]+", r"[0-9]+", r"(.)\1+"))
_CAPITAL = re.compile(r"[A-Z\u00c0-\u00de]")


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """A sparse random vector for each hash: three of its bits place +1 or -1 in each of the eight groups of four dimensions."""
    out, every = np.zeros((len(hashes), DIM), np.float32), np.arange(len(hashes))
    for group in range(DIM // 4):
        bits = (hashes >> np.uint64(3 * group)).astype(np.int64) & 7
        out[every, 4 * group + (bits & 3)] = np.where(bits & 4, 1, -1)
    return out


def word_hash(token: str) -> int:
    """Hash of the token's word; 64 bits stand for a word."""
    return word_hashes([token])[0]


def word_hashes(tokens: list[str]) -> list[int]:
    """Hashes of tokens without white space, put in lower case all at once."""
    return list(map(xxhash.xxh64_intdigest, "\n".join(tokens).lower().encode("utf-8", "surrogatepass").split(b"\n"))) if tokens else []


_SHAPE_INDEX = index_vectors(np.array([xxhash.xxh64_intdigest(b"shape %d" % k) for k in range(SHAPES)], np.uint64))


class _Shapes(dict):
    """Bucket of each shape, kept for a bounded number of shapes."""

    def __missing__(self, shape: str) -> int:
        if len(self) > 20_000:
            self.clear()
        out = self[shape] = zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES
        return out

    def of(self, tokens: list[str]) -> list[int]:
        """Buckets of tokens. A shape has one sign for a capital, a run of capitals, of letters and of digits; other characters once."""
        all_at_once = _CAPITAL.sub("X", _CAPITALS.sub("\x01", "\n".join(tokens)))
        return list(map(self.__getitem__, _SAME.sub(r"\1", _DIGITS.sub("9", _LETTERS.sub("x", all_at_once))).split("\n")))


class WordVectors:
    """Sorted hashes of the words with a context vector, these vectors, and those of the shapes."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, shapes: np.ndarray):
        self.words, self.contexts, self.shapes = words, contexts, shapes

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among those with a context vector, -1 for the others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out, at = index_vectors(hashes), self.slots(hashes)
        out[at >= 0] += self.contexts[at[at >= 0]]
        return out


class _Tokens(dict):
    """Numbers of tokens, with each one's word number, word hash, shape bucket and vector; kept for a bounded number of tokens."""

    def __init__(self, vectors: WordVectors):
        super().__init__()
        self.vectors, self.new, self.words, self.shapes = vectors, [], {}, _Shapes()
        self.columns = [np.zeros(1024, np.int64), np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros((1024, DIM), np.float32)]

    def __missing__(self, token: str) -> int:
        self[token] = out = len(self)
        self.new.append(token)
        return out

    def rows(self, tokens: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            hashes, known = word_hashes(self.new), self.words
            numbers = [known.setdefault(h, len(known)) for h in hashes]
            hashes = np.array(hashes, np.uint64)
            start, size = len(self) - len(self.new), len(self.columns[0])
            while size < len(self):
                size *= 2
            for k, values in enumerate((numbers, hashes, self.shapes.of(self.new), self.vectors.of(hashes))):
                if len(self.columns[k]) < size:
                    self.columns[k] = np.resize(self.columns[k], (size, *self.columns[k].shape[1:]))
                self.columns[k][start : len(self)] = values
            self.new = []
        return out

    def trim(self, most: int = 100_000) -> None:
        """Forget all tokens if there are more than ``most``; earlier numbers are void then."""
        if len(self) > most:
            self.clear()
            self.words.clear()


def frequent_words(docs: DataFrame, text_col: str = "text", flush: int = 100_000) -> np.ndarray:
    """Sorted hashes of the words that make up at least 1 / ``SHARE`` of all tokens; every word of every row is counted."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: Counter = Counter()

        def out():
            hashes = np.array(word_hashes(list(counts)), np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").split())
                if len(counts) > flush:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = C.written(counts, "quality-words")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / SHARE
    words = counts.where(F.col("n") >= least).select("word").toArrow().column(0).to_numpy()  # at most SHARE rows
    C.drop_written(counts)
    return np.sort(words.view(np.uint64))


def word_vectors(docs: DataFrame, text_col: str = "text", held_tokens: int = 200_000) -> WordVectors:
    """Context vectors of frequent words and of shapes, over all rows."""
    words = frequent_words(docs, text_col)
    empty = WordVectors(words, np.zeros((len(words), DIM), np.float32), np.zeros((SHAPES, DIM), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(empty)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens, n = _Tokens(shared.value), len(shared.value.words)
        codes, shapes, pairs, held = np.zeros((DIM // 4, 8 * n), np.int64), np.zeros(SHAPES * SHAPES, np.int64), [], 0

        def add():
            before, after = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            _, hashes, buckets, _ = tokens.columns
            np.add(shapes, np.bincount(buckets[before] * SHAPES + buckets[after], minlength=SHAPES * SHAPES), out=shapes)
            at = shared.value.slots(hashes[: len(tokens)])[before]
            known, following = 8 * at[at >= 0], hashes[after[at >= 0]]
            for group, count in enumerate(codes):  # how often each of the eight values of the group's bits follows
                count += np.bincount(known + ((following >> np.uint64(3 * group)) & np.uint64(7)).astype(np.int64), minlength=8 * n)
            pairs.clear()
            tokens.trim()

        for batch in batches:
            for text in batch.column(0):
                split = (text.as_py() or "").split()
                for k in range(0, len(split) - 1, held_tokens):
                    rows = tokens.rows(split[k : k + held_tokens + 1])
                    pairs.append((rows[:-1], rows[1:]))
                    held += len(rows)
                    if held > held_tokens:
                        add()
                        held = 0
        if pairs:
            add()
        counts = codes.reshape(DIM // 4, n, 2, 4)  # by group, word, sign and place
        contexts = (counts[:, :, 1] - counts[:, :, 0]).transpose(1, 0, 2).reshape(n, DIM)
        sums = np.concatenate([contexts, shapes.reshape(SHAPES, SHAPES) @ _SHAPE_INDEX])
        used = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, k]) for k in range(DIM))], names=["place", *(f"v{k}" for k in range(DIM))])

    columns = [f"v{k}" for k in range(DIM)]
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "place long, " + ", ".join(f"{c} double" for c in columns))
    total = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # at most SHARE + SHAPES rows
    context = np.zeros((len(words) + SHAPES, DIM))
    if total.num_rows:
        context[total.column(0).to_numpy()] = np.stack([total.column(c).to_numpy() for c in columns], 1)
    for part in (context[: len(words)], context[len(words) :]):  # less what the place's share of all contexts would give
        part -= part.sum(0) / max(1.0, np.abs(part).sum()) * np.abs(part).sum(1, keepdims=True)
    context *= np.sqrt(DIM // 4) / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    context = context.astype(np.float32)
    return WordVectors(words, context[: len(words)], _SHAPE_INDEX + context[len(words) :])


def pool(texts: Iterable[str | None], n_texts: int, tokens: _Tokens, group: int = 50_000) -> np.ndarray:
    """A row for each of ``n_texts`` whole texts: the means of its tokens' vectors and plain ratios; zeros without a word.

    Texts are cut into blocks of ``BLOCK`` words, and blocks are handled together, about ``group`` words at a time.
    """
    n_words, chars, sums, counted = np.zeros(n_texts), np.zeros(n_texts), np.zeros((n_texts, 2 * DIM)), np.zeros((n_texts, 3))
    words: list[str] = []
    of: list[int] = []
    sizes: list[int] = []

    def add():
        tokens.trim()
        rows, owner, size = tokens.rows(words), np.array(of), np.array(sizes)
        numbers, _, buckets, vectors = (c[rows] for c in tokens.columns)
        starts, block = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        np.add.at(sums, (owner, slice(0, DIM)), np.add.reduceat(vectors, starts, axis=0))
        np.add.at(sums, (owner, slice(DIM, None)), np.add.reduceat(tokens.vectors.shapes[buckets], starts, axis=0))
        again = block[1:][(numbers[1:] == numbers[:-1]) & (block[1:] == block[:-1])]
        for k, values in enumerate((again, _distinct(block, numbers), _distinct(block, buckets))):
            np.add.at(counted[:, k], owner[values], 1)
        words.clear(), of.clear(), sizes.clear()

    for i, text in enumerate(texts):
        split = (text or "").split()
        n_words[i], chars[i] = len(split), len(text or "")
        for k in range(0, len(split), BLOCK):
            part = split[k : k + BLOCK]
            words.extend(part)
            of.append(i)
            sizes.append(len(part))
            if len(words) > group:
                add()
    if words:
        add()
    n = np.maximum(n_words, 1)
    plain = np.stack([np.log1p(n) / 8, counted[:, 1] / n, counted[:, 0] / np.maximum(n - 1, 1), counted[:, 2] / n, chars / n / 20], 1)
    return np.concatenate([sums / n[:, None], plain], 1) * (n_words > 0)[:, None]


def _distinct(block: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The block of each distinct pair of a block and a value."""
    pairs = np.sort(block << 32 | values)
    return pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] >> 32


class Network:
    """Two layers with a tanh between them, fitted by Adam; ``temperature`` divides the logit."""

    def __init__(self, mean, scale, layers, temperature: float = 1.0):
        self.mean, self.scale, self.layers, self.temperature = mean, scale, layers, temperature

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, step: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        cal = np.arange(len(x)) % 5 == 4
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = (x - mean) / scale
        a, b = z[~cal], y[~cal].astype(float)
        weight = np.where(b > 0, 0.5 / max(b.mean(), 1e-3), 0.5 / max(1 - b.mean(), 1e-3)) if 0 < b.mean() < 1 else np.ones(len(b))
        weight = np.sqrt(weight)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for k in range(0, len(order), 128):
                at = order[k : k + 128]
                h = np.tanh(a[at] @ p[0] + p[1])
                e = weight[at] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - b[at]) / len(at)
                back = np.outer(e, p[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate((a[at].T @ back, back.sum(0), h.T @ e, np.array([e.sum()]))):
                    g = g + decay * p[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        out = cls(mean, scale, p)
        if cal.any():
            logit, want = out.logits(x[cal]), y[cal]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.logaddexp(0, -np.where(want > 0, logit, -logit) / t).mean() for t in grid]
            out.temperature = float(grid[int(np.argmin(loss))])
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.tanh((x - self.mean) / self.scale @ p[0] + p[1]) @ p[2] + p[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class QualityModel:
    """Word vectors and a network; ``scores`` gives the probability of label 1 for whole texts."""

    def __init__(self, vectors: WordVectors, network: Network | None, plain: float):
        self.vectors, self.network, self.plain, self.tokens = vectors, network, plain, None

    def scores(self, texts) -> np.ndarray:
        self.tokens = _Tokens(self.vectors) if self.tokens is None else self.tokens
        if self.network is None:
            return np.full(len(texts), self.plain)
        return self.network.probability(pool((t.as_py() for t in texts), len(texts), self.tokens))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Learn vectors from all rows of ``docs`` and the network from those that ``labels`` holds.

    Labels are 0 and 1; null ids and other labels are left out, and an id with several labels counts once for each. About
    ``sample`` labels are used, by hash of the id, and at most twice as many rows.
    """
    known = labels.select(F.col(label_id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(F.lit(3), "i"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    vectors = word_vectors(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = _Tokens(held.value)
        for batch in batches:
            x = pool((t.as_py() for t in batch.column(0)), batch.num_rows, tokens)
            yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), *batch.columns[1:]], names=["x", "y", "h"])

    # about ``sample`` rows, so every task can have them
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(known.limit(2 * sample)), "i")
    rows = rows.select("t", "y", F.xxhash64("i", "t").alias("h")).mapInArrow(run, "x array<float>, y int, h long").limit(2 * sample).toArrow()
    y = rows.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return QualityModel(vectors, None, float(y[0]) if len(y) else 0.5)
    order = np.argsort(rows.column("h").to_numpy(), kind="stable")
    x = np.stack(rows.column("x").to_numpy())[order].astype(float)
    return QualityModel(vectors, Network.fit(x, y[order]), 0.5)


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the probability of label 1 for each row of ``docs``.

    Null and empty texts are scored like any other, repeated rows each, and null ids are kept; other columns are not read. A model of
    labels of one kind gives that label, one without labels 0.5. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``; no shuffle."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(held.value.scores(batch.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its score; null and empty texts have one too. A row with a null id is not held out and has no label."""
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    scored = quality_scores(docs, fit_quality(docs, labels.where(~_held_out("doc_id"))))
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
