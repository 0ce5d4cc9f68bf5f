"""Best-two-fit packing of documents into fixed-length token sequences.

Lengths are at most ``capacity``, so what decides the packing is the number of pieces of each length: that histogram has
``capacity`` entries for any corpus. Bins are planned on it as patterns with a multiplicity, and Spark gives every piece
its place by its rank among the pieces of its length. Ranks are counted inside each task and shifted by a running sum
over (task, length) counts, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C


def best_two_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Plan bins of ``len(counts) - 1`` tokens for ``counts[n]`` pieces of each length n >= 1.

    A bin is filled greedily, the longest piece that fits first. If a gap stays, the bin's smallest piece of s tokens is
    replaced with the two unpacked pieces whose sum is the largest in (s, s + gap]. The same bin is repeated while all
    its pieces last. Returns (repeats, [(length, pieces of that length in a bin), ...]) for each pattern; every pattern
    but the last ones uses up a length, so their number is bounded by the capacity and not by the corpus.
    """
    capacity = len(counts) - 1
    counts = np.asarray(counts, dtype=np.int64).copy()
    counts[0] = 0
    index = np.arange(capacity + 1)
    out = []
    fits = np.maximum.accumulate(np.where(counts > 0, index, 0))  # the longest unpacked length up to each size
    while fits[capacity]:
        gap, most, uses = capacity, capacity, {}
        while gap and (n := int(fits[min(gap, most)])):
            uses[n] = min(int(counts[n]), gap // n)
            gap -= uses[n] * n
            most = n - 1
        if gap:
            s = min(uses)
            left = counts.copy()
            for n, k in uses.items():
                left[n] -= k
            left[s] = 0
            room = s + gap
            free = np.maximum.accumulate(np.where(left[: room + 1] > 0, index[: room + 1], 0))
            a = np.flatnonzero(left[:room] > 0)
            b = np.minimum(free[room - a], a)  # the partner is no longer than a
            again = (b == a) & (left[a] < 2)
            b[again] = free[np.maximum(np.minimum(room - a[again], a[again] - 1), 0)]
            total = np.where(b > 0, a + b, 0)
            if len(a) and (k := int(total.argmax())) >= 0 and total[k] > s:
                uses[s] -= 1
                if not uses[s]:
                    del uses[s]
                for n in (int(a[k]), int(b[k])):
                    uses[n] = uses.get(n, 0) + 1
        repeats = min(int(counts[n]) // k for n, k in uses.items())
        for n, k in uses.items():
            counts[n] -= repeats * k
        if any(counts[n] == 0 for n in uses):
            fits = np.maximum.accumulate(np.where(counts > 0, index, 0))
        out.append((repeats, sorted(uses.items(), reverse=True)))
    return out


def _places(patterns: list) -> dict[str, np.ndarray]:
    """For the pieces of each length, by rank: first sequence, pieces in a bin, and offset of the first of them."""
    rows, used, sequence = [], {}, 0
    for repeats, uses in patterns:
        offset = 0
        for n, k in uses:
            rows.append((n, used.get(n, 0), sequence, k, offset))
            used[n] = used.get(n, 0) + k * repeats
            offset += n * k
        sequence += repeats
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "uses", "offset"), columns))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, id_col: str, text_col: str, encode=None) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with ``part`` (the task) and ``place`` (among its pieces of that length)."""
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        enc, part, seen, size = encode or encoder(tokenizer).ids, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 4 * capacity
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc(text.as_py()) + tail
                for k in range(max(1, -(-len(ids) // size))):
                    piece = ids[k * size : (k + 1) * size]
                    n = len(piece) // 4
                    out.append((i, k, k * capacity, n, zlib.crc32(piece), part, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", encode=None) -> DataFrame:
    """Pack the ids of whole texts into sequences of at most ``capacity`` tokens: one row per piece.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is ``end_id`` alone
    (without one, a piece of no tokens in sequence -1). Repeated rows are packed each; a null id is kept; other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = C.written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, encode), "pieces")
    tally = C.written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity + 1 rows
        counts[row["length"]] = row["n"]
    places = _places(best_two_fit(counts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # grows with the tasks, so it is never broadcast; a key has the pieces of one task only
    ranked = pieces.join(shift.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("place")).alias("rank"))
    held = spark.sparkContext.broadcast(places)  # bounded by the capacity

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = held.value
        keys = (at["length"] << 46) + at["first"]
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            k = np.searchsorted(keys, (n << 46) + rank, side="right") - 1
            none = n == 0
            k[none] = 0
            r = rank - at["first"][k] if len(keys) else rank
            sequence = np.where(none, -1, at["sequence"][k] + r // at["uses"][k]) if len(keys) else np.full(len(n), -1)
            offset = np.where(none, 0, at["offset"][k] + r % at["uses"][k] * n) if len(keys) else np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every row of ``documents`` with its place; a null or empty text is the end id alone."""
    import public_tokenizers

    return pack(C.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
