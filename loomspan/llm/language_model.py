"""Brown class-based language model: exchange clustering, class transitions and word emissions.

All counts are over every training document. Word counts are a table (one row per distinct word, any number). The ``core`` most frequent
words are clustered by the exchange algorithm on their bigram matrix, where all other words are one more class. Then every other training word
makes its exchange move: its counts of the classes before and after it, a sparse table that Spark gathers by word, decide the class that raises the
class-bigram likelihood most. So each training word, however many there are, has a class from its contexts; only a word that training
has never seen takes the class that is commonest among words of its ending.

P(text) = product of P(class | previous class) * P(word | class), with the end as a class and a word of its own.
Transitions are counted over the final classes and smoothed towards the classes' frequencies; emissions discount seen words absolutely, and what
that frees is the probability of an unseen word in the class. For each history the probabilities of all known words and of an unseen one in each
class sum to 1.

Texts are coded once, a byte for the class of each token. The ``head`` most frequent words are looked up in each task; the others are left open and
joined with the table of words by Spark, which then fills them in. Transitions and scores read the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

END = b""  # no word is empty
OTHER = 1  # the unit and the class of words that have no unit of their own; 0 is the end's


def _split(text: str | None) -> list[bytes]:
    """Words of the text after A-Z are lower-cased; bytes, where both mean ASCII's letters and white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(train: DataFrame, text_col: str, flush: int = 150_000) -> DataFrame:
    """``word, n`` over all rows, with one end per row; tasks count in memory up to ``flush`` distinct words at a time."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(_split(text.as_py()))
                counts[END] += 1
                if len(counts) > flush:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Unit(dict):
    """Unit or number of a word; ``other`` for words without one."""

    def __init__(self, of: dict, other: int):
        super().__init__(of)
        self.other = other

    def __missing__(self, word: bytes) -> int:
        return self.other


def unit_bigrams(train: DataFrame, units, size: int, text_col: str) -> DataFrame:
    """``pair, n``: how often unit pair // size is followed by unit pair % size; a text begins after an end.

    ``units`` is the broadcast dictionary of the words that have a unit.
    """

    def run(batches: Iterator) -> Iterator:
        known, total, held, codes = _Unit(units.value, OTHER), np.zeros(size * size, np.int64), 0, []
        for batch in batches:
            for text in batch.column(0):
                words = _split(text.as_py())
                at = np.zeros(len(words) + 2, np.int64)
                at[1:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                codes.append(at[:-1] * size + at[1:])
                held += len(at)
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(codes), minlength=size * size)
                    held, codes = 0, []
        if codes:
            total += np.bincount(np.concatenate(codes), minlength=size * size)
        pairs = np.flatnonzero(total)
        for k in range(0, len(pairs), 100_000):
            own = pairs[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["pair", "n"])

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 6, fixed: int = 1) -> np.ndarray:
    """Class of each unit, by the exchange algorithm on a matrix of unit bigram counts.

    The first ``fixed`` units keep classes of their own; the others start by rank of frequency, in turn.
    """
    size = len(bigrams)
    b = bigrams.astype(float)
    order = np.argsort(-(b.sum(0) + b.sum(1)), kind="stable")
    order = order[order >= fixed]
    k_all = min(classes, size)
    free = max(1, k_all - fixed)
    of = np.zeros(size, np.int64)
    of[:fixed] = np.arange(fixed)
    of[order] = fixed + np.arange(len(order)) % free if k_all > fixed else 0
    one = np.zeros((size, k_all))
    one[np.arange(size), of] = 1
    table = one.T @ b @ one
    left, right = b @ one, one.T @ b  # unit -> class, class -> unit
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(rounds if k_all > fixed + 1 else 0):
        moved = 0
        for u in order:
            a, own = of[u], b[u, u]
            r, c = left[u].copy(), right[:, u].copy()
            r[a] -= own  # to and from other units
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            rows, columns = table.sum(1), table.sum(0)
            out, into = r.sum() + own, c.sum() + own
            gain = (f(table + r) - f(table)).sum(1) + (f(table + c[:, None]) - f(table)).sum(0)
            d = np.diagonal(table)
            gain += f(d + r + c + own) - f(d + r) - f(d + c) + f(d)
            gain -= f(rows + out) - f(rows) + f(columns + into) - f(columns)
            gain[:fixed] = -np.inf
            to = int(gain.argmax())
            if gain[to] <= gain[a] + 1e-9:
                to = a
            table[to] += r
            table[:, to] += c
            table[to, to] += own
            if to != a:
                moved += 1
                of[u] = to
                left[:, a] -= b[:, u]
                left[:, to] += b[:, u]
                right[a] -= b[u]
                right[to] += b[u]
        if not moved:
            break
    return of


def context_counts(train: DataFrame, names, classes: int, text_col: str, flush: int = 150_000) -> DataFrame:
    """``word, held`` of words out of the core: pairs of a slot and a count, as 32-bit numbers, of the classes around it in a part of the texts.

    Class c before the word is slot c, and after it slot ``classes`` + c. ``names`` is the broadcast pair of a dictionary that numbers the head,
    core words first, and the classes of the core. Words of the head are counted as numbers, others as bytes.
    """

    def run(batches: Iterator) -> Iterator:
        from array import array
        from collections import defaultdict

        number, of_core = names.value
        place, words_of = _Unit(number, -1), list(number)
        held, codes, rare, entries = 0, [], defaultdict(lambda: array("I")), 0

        def out(words: list, pairs: list):
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(pairs, pa.binary())], names=["word", "held"])

        def common():
            found, n = np.unique(np.concatenate(codes), return_counts=True)
            own, pairs = found // (2 * classes), np.stack([found % (2 * classes), n], 1).astype("<u4")
            cuts = np.flatnonzero(np.diff(own)) + 1
            first = np.concatenate([[0], cuts]) if len(own) else cuts
            for k in range(0, len(first), 20_000):
                ends = [*first[k + 1 : k + 20_001].tolist(), len(own)][: len(first[k : k + 20_000])]
                yield out([words_of[i] for i in own[first[k : k + 20_000]].tolist()], [pairs[x:y].tobytes() for x, y in zip(first[k : k + 20_000].tolist(), ends)])

        for batch in batches:
            for text in batch.column(0):
                words = _split(text.as_py())
                if not words:
                    continue
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                kind = np.zeros(len(at) + 2, np.int64)
                core = (at >= 0) & (at < len(of_core))
                kind[1:-1] = np.where(core, of_core[np.where(core, at, 0)], OTHER) if len(of_core) else OTHER
                before, after = kind[:-2], kind[2:] + classes
                own = at >= len(of_core)
                codes += [at[own] * 2 * classes + before[own], at[own] * 2 * classes + after[own]]
                for i in np.flatnonzero(at < 0).tolist():
                    rare[words[i]].extend((int(before[i]), 1, int(after[i]), 1))
                    entries += 1
                held += len(at)
                if held > 750_000:
                    yield from common()
                    held, codes = 0, []
                if entries > flush:
                    yield out(list(rare), [x.tobytes() for x in rare.values()])
                    rare.clear()
                    entries = 0
        if codes:
            yield from common()
        if rare:
            yield out(list(rare), [x.tobytes() for x in rare.values()])

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, held binary")


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def best_classes(slots: np.ndarray, n: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The exchange move of words out of OTHER: the class that raises the class-bigram likelihood most.

    ``table`` has the class bigram counts in which these words are OTHER's; ``slots`` and ``n`` are the words' context counts, those of
    one word after the other's, which begin at ``starts``.
    """
    k_all = len(table)
    lines = np.concatenate([table, table.T])  # by slot: counts with each class a word may join
    gain = np.zeros((len(starts), k_all))
    ends = np.append(starts[1:], len(slots))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 50_000, "right")))
        own = slice(starts[at], ends[to - 1])
        x, m = lines[slots[own]], n[own, None]
        x[:, OTHER] = np.maximum(x[:, OTHER] - n[own], 0)
        gain[at:to] = np.add.reduceat(_f(x + m) - _f(x), starts[at:to] - starts[at])
        at = to
    after = np.add.reduceat(np.where(slots >= k_all, n, 0), starts) if len(starts) else np.zeros(0)
    before = np.add.reduceat(np.where(slots < k_all, n, 0), starts) if len(starts) else np.zeros(0)
    for total, own in ((table.sum(1), after), (table.sum(0), before)):
        x = np.repeat(total[None], len(starts), 0)
        x[:, OTHER] = np.maximum(x[:, OTHER] - own, 0)
        gain -= _f(x + own[:, None]) - _f(x)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def word_classes(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """``word, n, k``: each word's count and the class that its contexts favour. One shuffle, by word."""
    k_all = len(table)

    def run(batches: Iterator) -> Iterator:
        for held in C.whole_shards(batches, 1):
            words = held.column("word").combine_chunks()
            codes = words.dictionary_encode()
            pairs = held.column("held").to_pylist()
            sizes = np.fromiter(map(len, pairs), np.int64, len(pairs)) // 8
            flat = np.frombuffer(b"".join(pairs), "<u4").reshape(-1, 2).astype(np.int64)
            key, where = np.unique(np.repeat(codes.indices.to_numpy().astype(np.int64), sizes) * 2 * k_all + flat[:, 0], return_inverse=True)
            n = np.bincount(where, flat[:, 1], len(key))
            starts = np.flatnonzero(np.concatenate([[True], np.diff(key // (2 * k_all)) > 0]))
            slots = key % (2 * k_all)
            count = np.add.reduceat(np.where(slots < k_all, n, 0), starts).astype(np.int64)  # a word has one class before it each time
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(count), pa.array(best_classes(slots, n, starts, table), pa.int64())], names=["word", "n", "k"])

    rows = contexts.select(F.xxhash64("word").alias("h"), "word", "held").repartition(C.shuffle_partitions(contexts.sparkSession), "h").sortWithinPartitions("h")
    return rows.mapInArrow(run, "word string, n long, k long")


class ClassModel:
    """``words`` (a table ``word, n, k``), each class's ``mass``, discount ``cut`` and log10 probability of an ``unseen`` word, ``steps`` (log10 transitions)."""

    def __init__(self, words: DataFrame, tokens: int, distinct: int, mass, cut, unseen, endings: dict[str, int], usual: int):
        self.words, self.tokens, self.distinct = words, tokens, distinct
        self.mass, self.cut, self.unseen, self.endings, self.usual, self.steps = mass, cut, unseen, endings, usual, None

    def base(self, n):
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def learn_steps(self, table: np.ndarray, pull: float) -> None:
        share = (table.sum(0) + 0.1) / (table.sum() + 0.1 * len(table))
        if not table.any():
            share = np.full(len(table), 1 / len(table))
        self.steps = np.log10((table + pull * share) / (table.sum(1, keepdims=True) + pull))


def _cluster(learn: DataFrame, ends: int, names: list[bytes], counts: list[int], core: int, classes: int, endings: int, tokens: int, distinct: int, text_col: str) -> ClassModel:
    spark = learn.sparkSession
    units = {END: 0} | {w: 2 + k for k, w in enumerate(names[:core])}
    size = 2 + len(names[:core])
    bigrams = np.zeros((size, size))
    found = unit_bigrams(learn, spark.sparkContext.broadcast(units), size, text_col).toArrow()  # at most size x size rows, whatever the corpus
    bigrams.ravel()[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    of = exchange(bigrams, classes, fixed=2)
    k_all = max(2, int(of.max()) + 1)
    one = np.zeros((size, k_all))
    one[np.arange(size), of] = 1
    numbers = spark.sparkContext.broadcast(({w: k for k, w in enumerate(names)}, of[2:]))
    moved = word_classes(context_counts(learn, numbers, k_all, text_col), one.T @ bigrams @ one)
    first = [(w.decode("utf-8", "surrogatepass"), int(n), int(k)) for w, n, k in zip(names[:core], counts, of[2:])]  # core words
    if ends:
        first.append(("", ends, 0))
    words = C.written(moved.unionByName(spark.createDataFrame(first, "word string, n long, k long")), "word-classes")
    sums = words.where("k > 0").groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    mass, cut, unseen, usual = np.ones(k_all), np.full(k_all, 0.5), np.zeros(k_all), (-1, OTHER)
    for r in sums.collect():  # a row for each class
        d = min(0.95, max(0.05, (r["once"] + 0.5) / (r["once"] + 2 * r["twice"] + 1)))
        mass[r["k"]], cut[r["k"]], unseen[r["k"]] = r["n"], d, np.log10(d * r["words"] / r["n"])
        usual = max(usual, (r["once"], r["k"]))
    by_ending = words.where("k > 0").groupBy(F.substring("word", -3, 3).alias("ending"), "k").agg(F.count(F.lit(1)).alias("n"))
    top = by_ending.groupBy("ending").agg(F.sum("n").alias("all"), F.max(F.struct("n", "k")).alias("best")).orderBy(F.desc("all"), "ending").limit(endings)
    return ClassModel(words, tokens, distinct, mass, cut, unseen, {r["ending"]: r["best"]["k"] for r in top.collect()}, usual[1])


def _coded(docs: DataFrame, train, model: ClassModel, names: list[bytes], head: DataFrame | None, rest: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, learn, n_tokens, known, base, emitted, codes``: a byte for the class of each word, and the sums that need no transitions."""
    spark = docs.sparkSession
    kinds, counts = np.zeros(len(names), np.int64), np.zeros(len(names))
    if names:
        found = head.toArrow()  # the head, bounded
        number = {w: k for k, w in enumerate(names)}
        at = np.array([number[w.encode("utf-8", "surrogatepass")] for w in found.column("word").to_pylist()])
        kinds[at], counts[at] = found.column("k").to_numpy(), found.column("n").to_numpy()
    emit = np.log10(np.maximum(counts - model.cut[kinds], 1e-9) / model.mass[kinds])
    sent = spark.sparkContext.broadcast(({w: k for k, w in enumerate(names)}, kinds, model.base(counts), emit, model.endings, model.usual))

    def code(batches: Iterator) -> Iterator:
        number, kinds, base, emit, endings, usual = sent.value
        place = _Unit(number, -1)
        for batch in batches:
            out = []
            for doc, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = _split(text.as_py())
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                holes = np.flatnonzero(at < 0)
                codes = (kinds[at] if len(kinds) else np.zeros(len(at), np.int64)).astype("u1")
                seen, rare = at[at >= 0], [words[i] for i in holes.tolist()]
                guess = [endings.get(w.decode("utf-8", "surrogatepass")[-3:], usual) for w in rare]
                out.append((doc, learn, len(words) + 1, len(seen), float(base[seen].sum()), float(emit[seen].sum()), codes.tobytes(), holes, rare, guess))
            kinds_of = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            columns = list(zip(*out)) if out else [[]] * len(kinds_of)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=["doc_id", "learn", "n_tokens", "seen", "base", "emitted", "codes", "holes", "words", "guess"])

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(train, F.lit(False)), F.col(text_col).cast("string"))
    rows = rows.mapInArrow(code, "doc_id long, learn boolean, n_tokens long, seen long, base double, emitted double, codes binary, holes array<int>, words array<binary>, guess array<long>")
    rows = C.written(rows.withColumn("row", F.monotonically_increasing_id()), "coded-open")
    rare = rows.select("row", F.explode(F.arrays_zip("holes", "words", "guess")).alias("r")).select("row", F.col("r.holes").alias("hole"), F.col("r.words").cast("string").alias("word"), F.col("r.guess").alias("guess"))
    rare = rare.join(rest, "word", "left").withColumn("k", F.coalesce("k", "guess"))
    constants = spark.createDataFrame([(k, float(model.mass[k]), float(model.cut[k]), float(model.unseen[k])) for k in range(len(model.mass))], "k long, mass double, cut double, unseen double")
    rare = rare.join(F.broadcast(constants), "k")  # a row for each class
    seen = F.col("n").isNotNull()
    of_rare = rare.groupBy("row").agg(
        F.count("n").alias("more"),
        F.sum(F.when(seen, F.log10((F.col("n") + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))).otherwise(float(model.base(0.0)))).alias("more_base"),
        F.sum(F.when(seen, F.log10((F.col("n") - F.col("cut")) / F.col("mass"))).otherwise(F.col("unseen"))).alias("more_emitted"),
        F.collect_list(F.struct("hole", F.col("k").cast("int"))).alias("filled"),
    )

    def fill(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for codes, filled in zip(batch.column(0).to_pylist(), batch.column(1)):
                if filled.is_valid:
                    own = np.frombuffer(codes, "u1").copy()
                    own[filled.values.field(0).to_numpy()] = filled.values.field(1).to_numpy()
                    codes = own.tobytes()
                out.append(codes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[2:]], names=["codes", "row", "doc_id", "learn", "n_tokens", "known", "base", "emitted"])

    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    both = rows.select("row", "doc_id", "learn", "n_tokens", "seen", "base", "emitted", "codes").join(of_rare, "row", "left")
    both = both.select("codes", "filled", "row", "doc_id", "learn", "n_tokens", more("seen", "more"), more("base", "more_base"), more("emitted", "more_emitted"))
    # lists of a row's words stay in a hash table for more keys than by default
    with C.conf_set(spark, spark__sql__objectHashAggregate__sortBased__fallbackThreshold="20000"):
        return C.written(both.mapInArrow(fill, "codes binary, row long, doc_id long, learn boolean, n_tokens long, known long, base double, emitted double"), "coded")


def _transitions(coded: DataFrame, k_all: int) -> np.ndarray:
    def run(batches: Iterator) -> Iterator:
        total = np.zeros(k_all * k_all, np.int64)
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                k = np.zeros(len(codes) + 2, np.int64)
                k[1:-1] = np.frombuffer(codes, "u1")
                total += np.bincount(k[:-1] * k_all + k[1:], minlength=k_all * k_all)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])

    found = coded.where("learn").select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # classes squared
    table = np.zeros(k_all * k_all)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(k_all, k_all)


def class_model(
    docs: DataFrame, train, core: int = 1024, classes: int = 64, endings: int = 510, head: int = 100_000, pull: float = 5.0, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[ClassModel, DataFrame]:
    """A model of the rows of ``docs`` where the boolean column ``train`` holds, and all rows as codes with their sums."""
    if not 2 <= classes <= 256:
        raise ValueError("a class is a byte: between 2 and 256 classes")
    learn = docs.where(F.coalesce(train, F.lit(False)))
    vocabulary = C.written(count_words(learn, text_col), "vocabulary")
    grade = F.floor(F.log2("n") * 8).alias("grade")
    grades = vocabulary.groupBy(grade).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()  # at most 8 x 63 rows
    tokens, distinct = sum(r["n"] for r in grades), sum(r["words"] for r in grades)
    least, held = 10**6, 0
    for r in sorted(grades, key=lambda r: -r["grade"]):
        if held + r["words"] > max(head, core):
            break
        least, held = r["grade"], held + r["words"]
    top = vocabulary.where((grade >= least) & (F.col("word") != "")).orderBy(F.desc("n"), "word").toArrow()  # at most ``head`` rows
    names = [w.encode("utf-8", "surrogatepass") for w in top.column("word").to_pylist()]
    ends = vocabulary.where(F.col("word") == "").agg(F.sum("n")).first()[0] or 0
    model = _cluster(learn, ends, names, top.column("n").to_pylist(), core, classes, endings, tokens, distinct, text_col)
    words = model.words.where(F.col("word") != "")
    coded = _coded(docs, train, model, names, words.where(grade >= least), words.where(grade < least), id_col, text_col)
    model.learn_steps(_transitions(coded, len(model.mass)), pull)
    return model, coded


def class_model_scores(docs: DataFrame, train, **options) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``train`` is a boolean column of ``docs``: the rows that the model learns from; null is false. Both scores are log10 probabilities;
    ``base_score`` is the additive unigram model's. A null text is empty and is the end alone. Repeated rows count each, null
    ids are kept, other columns are not read. With no training row every word is unseen. An empty table gives no rows.
    """
    model, coded = class_model(docs, train, **options)
    ends = model.words.where(F.col("word") == "").agg(F.sum("n")).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(model.steps)

    def score(batches: Iterator) -> Iterator:
        steps = sent.value
        for batch in batches:
            out = []
            for codes in batch.column(0).to_pylist():
                k = np.zeros(len(codes) + 2, np.int64)
                k[1:-1] = np.frombuffer(codes, "u1")
                out.append(float(steps[k[:-1], k[1:]].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), *batch.columns[1:]], names=["walk", "row", "doc_id", "n_tokens", "known", "base", "emitted"])

    rows = coded.select("codes", "row", "doc_id", "n_tokens", "known", "base", "emitted").mapInArrow(score, "walk double, row long, doc_id long, n_tokens long, known long, base double, emitted double")
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + float(model.base(float(ends)))).alias("base_score"),
        (F.col("emitted") + F.col("walk")).alias("score"),
        F.col("row").alias("row_no"),
    )


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its length and log10 probabilities under the base and the class model; learning leaves out ids of remainder 0.

    A null text is empty; a row with a null id is not held out, and not learnt from either, as its remainder is null.
    """
    docs = C.read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = class_model_scores(docs, ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
