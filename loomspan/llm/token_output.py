"""Token-id output: a concatenated id array per segment file, with Elias-Fano coded document boundaries.

Segment file (little-endian):

========  =====================================================================
bytes     content
========  =====================================================================
8         magic ``LOOMEF01``
5 x u64   documents, tokens, documents with a null id, bytes per id (2 or 4), smallest document id (as signed)
...       Elias-Fano sequence: tokens up to and including each document
...       Elias-Fano sequence: document ids minus the smallest (nulls, which sort first, left out)
...       the ids of all documents, one after another
========  =====================================================================

An Elias-Fano sequence of n values up to u keeps floor(log2(u/n)) low bits of each value in a packed array and the
high parts in unary in a bit vector of at most 3n bits; every 256th one-bit's place is kept as 32-bit number, so
``select`` (the i-th value) reads one sample and a few words. That is about 2 + log2(u/n) bits a document in place of 64.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

MAGIC, SAMPLE = b"LOOMEF01", 256


class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, "u1"), np.zeros(0, "<u8"), np.zeros(0, "<u4"))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype("u1").ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) // 64 + 1) * 64, dtype="u1")
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, from the sampled place and the words after it."""
        place = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, place // 64
        bits = int(self.high[word]) >> (place % 64) << (place % 64)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        one = word * 64 + (bits & -bits).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self.low[at >> 3]) >> (at & 7) & 1) << k
        return ((one - i) << self.low_bits) | low

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high.view("u1"), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def write(self, out: io.BytesIO) -> None:
        out.write(struct.pack("<5Q", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)))
        for part in (self.low, self.high, self.samples):
            out.write(part.tobytes())

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<5Q", data, at)
        at += 40
        low = np.frombuffer(data, "u1", a, at)
        high = np.frombuffer(data, "<u8", b, at + a)
        samples = np.frombuffer(data, "<u4", c, at + a + 8 * b)
        return cls(n, low_bits, low, high, samples), at + a + 8 * b + 4 * c


def segment_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A segment of documents in ascending id order, nulls first; ids: each document's as unsigned 32-bit numbers."""
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    every = np.frombuffer(b"".join(ids), "<u4")
    if len(every) and int(every.max()) >= 1 << 8 * width:
        raise ValueError(f"id {int(every.max())} does not fit into {width} bytes")
    known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    low = int(known[0]) if len(known) else 0
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<4Qq", len(ids), int(ends[-1]) if len(ends) else 0, len(doc_ids) - len(known), width, low))
    EliasFano.encode(ends).write(out)
    EliasFano.encode(known.astype(np.uint64) - np.uint64(low % 2**64)).write(out)
    out.write(every.astype(f"<u{width}").tobytes())
    return out.getvalue()


class Segment:
    """A segment file's content: ``bounds(i)`` gives a document's place by select, ``ids(i)`` its ids."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a segment file")
        self.n_docs, self.n_tokens, nulls, width, low = struct.unpack_from("<4Qq", view, 8)
        self.ends, at = EliasFano.read(view, 48)
        known, at = EliasFano.read(view, at)
        self.doc_ids = [None] * nulls + [int(x) for x in (known.decode() + np.uint64(low % 2**64)).astype(np.int64)]
        self.tokens = np.frombuffer(view, f"<u{width}", self.n_tokens, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.tokens[start:end]


def put_file(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a task that runs twice leaves one whole file."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as f:
        f.write(data)
    files.move(part, path)


def get_file(uri: str) -> bytes:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def _width(tokenizer: str, end_id: int | None, encode) -> int:
    if encode:
        return 4
    from tokenizers import Tokenizer

    return 2 if max([end_id or 0, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()]) < 1 << 16 else 4


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 4_000_000, width: int | None = None, encode=None
) -> DataFrame:
    """Encode whole texts and write segment files under ``path`` in ascending id order; returns the manifest.

    Documents are range-partitioned by id, so every segment covers a range of ids and memory is bounded by one
    segment. A null text has no ids but ``end_id``; rows with a null id come first; repeated ids are kept, in the
    order of their text's hash. Other columns are not read. ``width`` is the bytes of an id: 2 if the tokenizer's vocabulary and the end have
    no id above 65,535, else 4; an id that does not fit into a given width is an error.
    Manifest columns: ``segment_part, segment_no, file, n_docs, n_tokens``; an empty input gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange(C.shuffle_partitions(spark), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    width = width or _width(tokenizer, end_id, encode)

    def encode_part(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        part, no, held = TaskContext.get().partitionId(), 0, 0
        enc = encode or encoder(tokenizer).ids
        doc_ids: list = []
        ids: list[bytes] = []

        def flush():
            nonlocal no, held, doc_ids, ids
            file = f"{path}/segment-{part:06d}-{no:06d}.efids"
            put_file(file, segment_bytes(doc_ids, ids, width))
            row = pa.RecordBatch.from_pydict({"segment_part": [part], "segment_no": [no], "file": [file], "n_docs": [len(ids)], "n_tokens": [held]})
            no, held, doc_ids, ids = no + 1, 0, [], []
            return row

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = enc(text.as_py()) + tail
                if ids and held + len(found) // 4 > segment_tokens:
                    yield flush()
                doc_ids.append(i)
                ids.append(found)
                held += len(found) // 4
        if ids:
            yield flush()

    return C.written(rows.mapInArrow(encode_part, "segment_part long, segment_no long, file string, n_docs long, n_tokens long"), "token-manifest")


def read_token_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the segment files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` is the number of ids of all documents before it; the running sum is over one manifest row per segment.
    """
    before = Window.orderBy("segment_part", "segment_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    files = files.repartition(C.shuffle_partitions(manifest.sparkSession), "file")

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Segment(get_file(file))
                ends = np.array([0, *map(s.ends.select, range(s.n_docs))], dtype=np.int64)
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                out = {"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(ends[:-1] + base), "n_tokens": pa.array(np.diff(ends))}
                out["ids_crc32"] = pa.array([zlib.crc32(s.tokens[a:b].astype("<u4")) for a, b in spans], pa.int64())
                if with_ids:
                    out["ids"] = pa.array([s.tokens[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op6_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` from its segment file, its place found by ``select``; a null text is the end id alone, null ids come first."""
    import public_tokenizers

    docs = C.read(spark, sf_dir, "documents")
    manifest = write_token_ids(docs, C.new_folder(spark, "token-ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(manifest)
