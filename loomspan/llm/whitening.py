"""PCA whitening of embeddings with MLlib's block matrices.

Vectors become integers first, so that the sums that the centre depends on are exact. Rows are indexed and dealt into distributed blocks, and centred there; the
transpose of the block matrix times itself is the scatter, whose inner dimension is split over tasks, so that no task sees all rows. Only the
d x d scatter reaches the driver, for its eigenvectors. A second product of blocks, with the d x k whitening matrix, projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _common as C

EXACT = 2.0**62  # below it sums of products of longs are safe
COLUMNS = 1024  # of a block

AT_SQL = "struct<_1: long, _2: long>"
BLOCK_SQL = "struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, values: array<double>, isTransposed: boolean>"
AT = pa.struct([("_1", pa.int64()), ("_2", pa.int64())])
BLOCK = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``id, x``: ``floor(scale * c) + shift`` of each entry, as longs; vectors that are null or hold a null, non-finite or too large entry are left out.

    Too large is what a double no longer holds to the unit: ``scale * abs(c)`` of 2 ** 53 or more.
    """
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0**53 / scale))
    return vectors.where(fine).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _summed(rows: DataFrame, of, size: int, kind: str) -> list:
    """Sums over all rows of the numbers that ``of`` makes of a batch; a task sends one row of them, Spark adds the rows place by place."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = of(batch) if total is None else total + of(batch)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size), pa.int32()), "v": pa.array([str(v) for v in total] if kind == "decimal(38,0)" else total, pa.string() if kind == "decimal(38,0)" else pa.float64())})

    made = rows.mapInArrow(part, "at int, v string" if kind == "decimal(38,0)" else "at int, v double")
    out = dict.fromkeys(range(size), 0)
    out |= {r.at: r.v for r in made.groupBy("at").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()}  # as many rows as a vector or its scatter has places
    return [out[k] for k in range(size)]


def _sum_of_longs(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = _matrix(batch.column(0), d)
    return (x if np.abs(x).max(initial=0) * float(len(x)) < EXACT else x.astype(object)).sum(0).astype(object)


def _blocks(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], height: int, width: int) -> Iterator[pa.RecordBatch]:
    """From whole blocks of numbered rows (``at, row, id, x``): pieces of ``width`` columns of the centred rows, and with the first of them the ids and deviations."""
    d = len(sums)
    whole = np.array(sums, object)
    for table in C.whole_shards(batches, 1):
        at, row, x = table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(3), d)
        ids = table.column(2).combine_chunks()
        small = float(np.abs(x).max(initial=0)) * n < EXACT and max(abs(s) for s in sums) < EXACT
        apart = x * n - whole.astype(np.int64) if small else x.astype(object) * n - whole
        squares = (apart * apart).sum(1) if small and float(np.abs(apart).max(initial=0)) ** 2 * d < EXACT else (apart.astype(object) ** 2).sum(1)
        centred = (apart / n).astype(float)
        for k in np.unique(at):
            own = np.flatnonzero(at == k)
            own = own[np.argsort(row[own])]
            deviation = [int(v) if v < 2**63 else None for v in squares[own]]
            for j in range(0, d, width):
                piece = centred[own, j : j + width]
                block = {"type": 1, "numRows": len(own), "numCols": piece.shape[1], "colPtrs": None, "rowIndices": None, "values": piece.ravel(order="F"), "isTransposed": False}
                held = [ids.take(pa.array(own)), deviation] if not j else [None, None]
                columns = [pa.array([{"_1": k, "_2": j // width}], AT), pa.array([block], BLOCK), pa.array([held[0] and held[0].to_pylist()], pa.list_(ids.type)), pa.array([held[1]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "block", "ids", "deviation"])


def _entries(block: pa.StructScalar) -> np.ndarray:
    """A dense block as an array."""
    shape = block["numRows"].as_py(), block["numCols"].as_py()
    v = block["values"].values.to_numpy()
    return v.reshape(shape) if block["isTransposed"].as_py() else v.reshape(shape[::-1]).T


def _long_form(batches: Iterator[pa.RecordBatch], rank: int) -> Iterator[pa.RecordBatch]:
    """A row for each row and column of a block, with the row's id and deviation; columns from ``rank`` on are null."""
    for batch in batches:
        for block, ids, deviation in zip(*batch.columns):
            w = _entries(block)
            n, k = w.shape
            each = pa.array(np.repeat(np.arange(n), k))
            component = np.tile(np.arange(k, dtype=np.int32), n)
            white = pa.array(w.ravel(), mask=component >= rank)
            yield pa.RecordBatch.from_arrays([ids.values.take(each), pa.array(component + np.int32(1)), deviation.values.take(each), white], names=["id", "component", "deviation", "whitened"])


def block_height(n: int, d: int) -> int:
    """Rows of a block: blocks of up to 8 MB, more than a few of them, and never over half a million, as the driver holds the key of each."""
    return max(min(max(1, 2**20 // d), max(256, n // 2_000)), -(-n // 500_000))


def _as_matrix(spark, path: str, n: int, d: int, height: int, width: int) -> BlockMatrix:
    """The block matrix of a written table; blocks go from the files to MLlib inside the JVM."""
    schema = StructType([StructField("at", StructType([StructField("_1", LongType()), StructField("_2", LongType())])), StructField("block", MatrixUDT())])
    return BlockMatrix(callMLlibFunc("createBlockMatrix", spark.read.schema(schema).parquet(path), height, width, n, d), height, width)


def scatter_of(blocks: BlockMatrix, most_blocks: int = 4) -> np.ndarray:
    """Transpose times the matrix itself. The inner dimension is split, so a task multiplies ``most_blocks`` pairs of blocks and partial products are added."""
    splits = -(-blocks.numRows() // blocks.rowsPerBlock // most_blocks)
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, max(1, int(splits)))
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def whiten(rows: DataFrame, components: int = 32) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of integer vectors (``id, x``), one row for each vector and component.

    ``deviation``: sum over the dimensions of (n * x - sum) ** 2, exact; null where it does not fit in a long. ``whitened``: the centred vector on the component, over the
    square root of its eigenvalue. Components number from 1 by falling eigenvalue, at most ``components`` and the width of the vectors. A component without
    variance (an eigenvalue that cannot be told from zero) has a null ``whitened`` and stays out of ``identity_error``, which is the largest absolute entry of the whitened rows' covariance
    less the identity (null without any variance, like ``explained``). Vectors of another length than most (of equally frequent lengths: the longest) are left out. Repeated rows and ids all stay; null ids
    stay; an empty table, and a table of empty vectors, gives no rows.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    held = C.written(rows.withColumn("at", F.monotonically_increasing_id()), "vectors-whole")
    usual = held.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None or usual.d == 0:
        return empty
    d, n, k = usual.d, usual["count"], min(components, usual.d)
    if n < held.count():  # the places of a partition must have no gaps
        held = C.written(held.where(F.size("x") == d).select("id", "x", F.monotonically_increasing_id().alias("at")), "vectors-whole")
    part = F.shiftright("at", 33)
    before, shift = 0, []
    for r in held.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row for each partition of the table
        shift.append((r.p, before))
        before += r["count"]
    shifts = F.broadcast(spark.createDataFrame(shift, "p long, shift long"))
    height, width, ids = block_height(n, d), min(d, COLUMNS), dict(rows.dtypes)["id"]
    numbered = held.join(shifts, part == F.col("p")).select("id", (F.col("shift") + F.col("at").bitwiseAND(2**33 - 1)).alias("row"), "x")
    numbered = numbered.select(F.floor(F.col("row") / height).alias("at"), "row", "id", "x").repartition(C.shuffle_partitions(spark), "at").sortWithinPartitions("at")
    sums = [int(s) for s in _summed(held.select("x"), lambda b: _sum_of_longs(b, d), d, "decimal(38,0)")]
    centred = C.written(numbered.mapInArrow(lambda b: _blocks(b, n, sums, height, width), f"at {AT_SQL}, block {BLOCK_SQL}, ids array<{ids}>, deviation array<long>"), "vectors-centred")

    blocks = _as_matrix(spark, C.folder_of(centred), n, d, height, width)
    covariance = scatter_of(blocks) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes, trace = np.maximum(values[::-1][:k], 0), axes[:, ::-1][:, :k], float(np.trace(covariance))
    rank = int((values > values[0] * d * 1e-14).sum()) if values[0] > 0 else 0
    matrix = axes / np.where(np.arange(k) < rank, np.sqrt(np.where(values > 0, values, 1)), np.inf)
    pieces = [((i // width, 0), DenseMatrix(len(own), k, own.ravel(order="F"))) for i in range(0, d, width) for own in [matrix[i : i + width]]]
    projected = blocks.multiply(BlockMatrix(spark.sparkContext.parallelize(pieces, 1), width, k, d, k))
    path = C.new_folder(spark, "vectors-whitened")
    callMLlibFunc("getMatrixBlocks", projected._java_matrix_wrapper._java_model).toDF("at", "block").write.parquet(path)
    whitened = spark.read.schema(f"at {AT_SQL}, block {BLOCK_SQL}").parquet(path)

    mean = np.array(_summed(whitened.select("block"), lambda b: sum(_entries(m).sum(0) for m in b.column(0)), k, "double")) / n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        return sum(((m - mean).T @ (m - mean)).ravel() for m in map(_entries, batch.column(0)))

    spread = np.array(_summed(whitened.select("block"), products, k * k, "double")).reshape(k, k)[:rank, :rank] / n
    error = float(np.abs(spread - np.eye(rank)).max()) if rank else None
    of_block = centred.where(F.col("ids").isNotNull()).select(F.col("at._1").alias("b"), "ids", "deviation").join(whitened.select(F.col("at._1").alias("b"), "block"), "b")
    long = of_block.select("block", "ids", "deviation").mapInArrow(lambda b: _long_form(b, rank), f"id {ids}, component int, deviation long, whitened double")
    share = F.lit([float(v / trace) for v in values])[F.col("component") - 1] if trace > 0 else F.lit(None)
    return long.select("id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All ``embeddings`` projected on the 32 leading components of their covariance, each scaled to unit variance.

    Vectors that are null or hold null or non-finite entries are left out; null ids stay, and equal rows each give rows of their own; an empty table gives no rows.
    """
    return whiten(whole_numbers(C.read(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")
