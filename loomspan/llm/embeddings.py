"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, with multiprobe and verified pairs.

Equal vectors of a label are one class first, so a vector that a third of all rows share is hashed once. A class's home
bucket in a table is the pair of nearest signed axes after two pseudo-random rotations; it also visits the buckets of the
next-nearest axes. Only a class's number and a sketch of 256 signs are dealt to the buckets, not its vector. In a bucket homes meet homes and
visitors; pairs with near sketches are candidates, of which a spanning forest leaves the task. Buckets with many homes or visitors are cut into
blocks of both, each of which meets the others in a task of its own.

The candidates' components then have their vectors, each sent once (to as many tasks as a very large component has blocks), and there every pair
is verified in double precision, so all links inside a component are found and counted, also those that no bucket has shown.

With four tables of two hashes and three visited buckets, links at a cosine of 0.98 in 64 dimensions are found with
probability over 0.999 (measured; links above it more often).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .forest import Forest

#: at a cosine of 0.98, 16 signs of 256 differ on average (standard deviation 4), and at one of 0.7, as vectors with a common mean have, 64 (standard deviation 7)
SIGNS, APART = 256, 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(x: np.ndarray, tables: int, probes: int, seed: int = 11) -> np.ndarray:
    """For each row and table the home bucket and, after it, ``probes`` visited ones (rows x tables x (1 + probes))."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    combos = np.array([(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)]) % min(3, width)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        codes, losses = [], []
        for k in range(2):
            y, rng = x, np.random.default_rng((seed, t, k))
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            value = np.take_along_axis(y, near, 1)
            codes.append(near * 2 + (value < 0))
            losses.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        keys = codes[0][:, combos[:, 0]] * 2 * width + codes[1][:, combos[:, 1]]
        order = np.argsort(losses[0][:, combos[:, 0]] + losses[1][:, combos[:, 1]], axis=1, kind="stable")[:, : 1 + probes]
        order = np.concatenate([np.zeros((n, 1), np.int64), np.stack([r[r != 0][:probes] for r in order])], 1) if probes else order * 0
        out[:, t] = np.take_along_axis(keys, order, 1)
    return out


def sketches(x: np.ndarray, seed: int = 23) -> np.ndarray:
    """256 signs of each row after pseudo-random rotations, as four numbers; zeros where there are too few dimensions to rotate."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    if width < 16:
        return np.zeros((n, SIGNS // 64), np.uint64)
    x, out = np.pad(x, ((0, 0), (0, width - d))), []
    for r in range(-(-SIGNS // width)):
        y, rng = x, np.random.default_rng((seed, r))
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], width))
        out.append(y > 0)
    return np.packbits(np.concatenate(out, 1)[:, :SIGNS], axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive runs."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def near_pairs(starts: np.ndarray, sizes: np.ndarray, home: np.ndarray, own: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray], small: int = 64, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of rows of one shard, the second of which is a home, in bounded parts.

    Two homes are a pair only where ``own`` holds, that is in the shard that their block has for itself. Shards are runs of rows. Small ones are paired many at a time, and large ones a block of rows against a block of homes at a time.
    """
    few = sizes <= small
    row, later = np.repeat(starts[few], sizes[few]) + _within(sizes[few]), np.repeat(sizes[few], sizes[few]) - 1 - _within(sizes[few])
    part = np.cumsum(later) // 200_000
    for k in range(int(part[-1]) + 1 if len(part) else 0):
        here = part == k
        i = np.repeat(row[here], later[here])
        j = i + 1 + _within(later[here])
        i, j = np.where(home[j], i, j), np.where(home[j], j, i)
        use = home[j] & (own[j] | ~home[i])
        i, j = i[use], j[use]
        use = close(i, j)
        yield i[use], j[use]
    for start, size in zip(starts[~few], sizes[~few]):
        at = start + np.flatnonzero(home[start : start + size])
        order = np.concatenate([at, start + np.flatnonzero(~home[start : start + size])])
        for lo in range(0 if own[start] else len(at), size, rows):
            for first in range(0, min(len(at), lo + rows), rows):  # a home meets earlier homes and its own block, a visitor all homes
                i, j = np.meshgrid(np.arange(lo, min(size, lo + rows)), np.arange(first, min(len(at), first + rows)), indexing="ij")
                use = (i >= len(at)) | (i > j)
                i, j = order[i[use]], order[j[use]]
                use = close(i, j)
                yield i[use], j[use]


def _runs(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the shards of a table."""
    columns = [table.column(c).to_numpy() for c in range(keys)]
    starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    return starts, np.diff(np.append(starts, table.num_rows))


def _roles(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are homes, and which are in the shard of a block with itself."""
    return table.column("home").to_numpy(), table.column("m").to_numpy() == table.column("f").to_numpy()


def _vectors(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(column) else []


def _units(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(float)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucketed(good: DataFrame, tables: int, probes: int) -> DataFrame:
    """``vec_id, h1, h2, of, sketch, keys`` of each row; ``of`` is the hash of its label and length."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _vectors(batch.column(4))
            sizes = np.array([len(x) for x in rows])
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                x = _units([rows[i] for i in own])
                keys = bucket_keys(x, tables, probes).astype("<u4").reshape(len(own), -1)
                parts = [batch.column(c).take(pa.array(own)) for c in range(4)]
                held = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (sketches(x).astype("<u8"), keys)]
                yield pa.RecordBatch.from_arrays([*parts, *held], names=["vec_id", "h1", "h2", "of", "sketch", "keys"])

    return good.select("vec_id", "h1", "h2", F.xxhash64("label", F.size("v")).alias("of"), "v").mapInArrow(run, "vec_id long, h1 long, h2 long, of long, sketch binary, keys binary")


def _candidates(classes: DataFrame, tables: int, probes: int, block: int) -> DataFrame:
    """``a, b``: a spanning forest of the candidates of each bucket."""
    spark = classes.sparkSession
    width = 1 + probes

    def spread(batches: Iterator) -> Iterator:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(n, tables, width)
            every = np.arange(n)
            for t in range(tables):
                for k in range(width):
                    use = every if k == 0 else np.flatnonzero(np.all(keys[:, t, k : k + 1] != keys[:, t, :k], axis=1))
                    where = (np.int64(t) << np.int64(32)) + keys[use, t, k].astype(np.int64)
                    parts = [batch.column(c).take(pa.array(use)) for c in (0, 1, 2)]
                    yield pa.RecordBatch.from_arrays([*parts, pa.array(where), pa.array(np.full(len(use), k == 0))], names=["cls", "of", "sketch", "place", "home"])

    rows = classes.select("cls", "of", "sketch", "keys").mapInArrow(spread, "cls long, of long, sketch binary, place long, home boolean")
    rows = rows.select(F.xxhash64("of", "place").alias("bucket"), "cls", "sketch", "home")
    counts = rows.groupBy("bucket").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors"))
    # written, so that its size is known when the join is planned: mostly empty, it is broadcast and the rows stay where they are
    heavy = counts.where((F.col("homes") > block) | ((F.col("homes") > 0) & (F.col("visitors") > 2 * block)))
    heavy = C.written(heavy.select("bucket", F.ceil(F.col("homes") / block).cast("int").alias("h"), F.ceil(F.col("visitors") / block).cast("int").alias("v")), "heavy-buckets")
    h, v, last = F.col("h"), F.col("v"), F.col("h") + F.col("v") - 1
    own = F.pmod(F.xxhash64("cls"), F.greatest(F.when(F.col("home"), h).otherwise(v), F.lit(1))).cast("int")
    spot = lambda m, f, fixed: F.struct(m.alias("m"), f.alias("f"), F.lit(fixed).alias("fixed"))
    one = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("f"), F.col("home").alias("fixed")))
    earlier = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda f: spot(F.col("own"), f, False))).otherwise(F.slice(one, 1, 0))
    of_home = F.concat(F.transform(F.sequence(F.col("own"), last), lambda m: spot(m, F.col("own"), True)), earlier)
    of_visitor = F.transform(F.sequence(F.lit(0), h - 1), lambda f: spot(h + F.col("own"), f, False))
    rows = rows.join(heavy, "bucket", "left").withColumn("own", own)
    rows = rows.select("bucket", F.explode(F.when(h.isNull(), one).when(F.col("home"), of_home).otherwise(of_visitor)).alias("s"), "cls", "sketch")
    rows = rows.select("bucket", F.col("s.m").alias("m"), F.col("s.f").alias("f"), F.col("s.fixed").alias("home"), "cls", "sketch")

    def meet(batches: Iterator) -> Iterator:
        for table in C.whole_shards(batches, 3):
            starts, sizes = _runs(table, 3)
            cls, forest = table.column("cls").to_numpy(), Forest(table.num_rows)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(-1, SIGNS // 64)
            close = lambda i, j: sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int16) for s in sketch.T) <= APART  # noqa: B023, E731
            for i, j in near_pairs(starts, sizes, *_roles(table), close):
                forest.add(i, j)
            child, root = forest.roots()
            yield pa.RecordBatch.from_arrays([pa.array(cls[child]), pa.array(cls[root])], names=["a", "b"])

    rows = rows.repartition(C.shuffle_partitions(spark), "bucket", "m", "f").sortWithinPartitions("bucket", "m", "f")
    return C.written(rows.mapInArrow(meet, "a long, b long").distinct(), "vector-candidates")


def _links(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """``cls, links, up``: of ``cls, comp, many, v``, links of each class with others of its component, and edges that span them.

    A class comes once for each pair of blocks that its component is cut into; its links are the sum.
    """
    spark = members.sparkSession
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    rows = C.join_heavy(members, C.written(sizes, "component-sizes"), "comp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int"))
    spot = lambda m, f, fixed: F.struct(m.alias("m"), f.alias("f"), F.lit(fixed).alias("fixed"))
    fixed = F.transform(F.sequence(F.col("own"), F.col("cuts") - 1), lambda m: spot(m, F.col("own"), True))
    earlier = F.transform(F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda f: f < F.col("own")), lambda f: spot(F.col("own"), f, False))
    rows = rows.select("comp", F.explode(F.concat(fixed, earlier)).alias("s"), "cls", "many", "v")
    rows = rows.select("comp", F.col("s.m").alias("m"), F.col("s.f").alias("f"), F.col("s.fixed").alias("home"), "cls", "many", "v")

    def meet(batches: Iterator) -> Iterator:
        for table in C.whole_shards(batches, 3):
            starts, sizes = _runs(table, 3)
            cls, many, n = table.column("cls").to_numpy(), table.column("many").to_numpy(), table.num_rows
            rows = _vectors(table.column("v"))
            lengths = np.array([len(x) for x in rows])
            unit = np.zeros((n, int(lengths.max())))
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                unit[own, :d] = _units([rows[i] for i in own])
            links, forest = np.zeros(n), Forest(n)
            for i, j in near_pairs(starts, sizes, *_roles(table), lambda i, j: np.einsum("nd,nd->n", unit[i], unit[j]) >= cosine):  # noqa: B023
                forest.add(i, j)
                links += np.bincount(i, many[j], n) + np.bincount(j, many[i], n)
            child, root = forest.roots()
            up = np.full(n, -1, np.int64)
            up[child] = cls[root]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links.astype(np.int64)), pa.array(up)], names=["cls", "links", "up"])

    rows = rows.repartition(C.shuffle_partitions(spark), "comp", "m", "f").sortWithinPartitions("comp", "m", "f")
    return C.written(rows.mapInArrow(meet, "cls long, links long, up long"), "vector-links")


def embedding_duplicates(
    vectors: DataFrame, cosine: float = 0.98, tables: int = 4, probes: int = 3, block: int = 8_000, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Only rows of equal, non-null labels are compared, and only vectors of equal length. A vector that is null, empty or
    zero or holds a null or a non-finite component has no link. Copies link with each other. Repeated ids give repeated
    rows; a null id is kept, is never a component's smallest id unless all are null, and then ``kept`` is null. An
    empty table gives no rows; other columns are not read. ``block`` does not change the result. Candidates are meant for a ``cosine``
    of 0.98 or more.
    """
    v = F.col("v")
    fine = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), v)).withColumns({"h1": F.xxhash64(F.lit(1), "label", "v"), "h2": F.xxhash64(F.lit(2), "v", "label")})
    good = rows.where(v.isNotNull())
    keyed = C.written(_bucketed(good, tables, probes), "vector-keys")
    classes = keyed.groupBy("h1", "h2", "of", "sketch", "keys").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least"))
    classes = C.written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    near = C.connected_components(_candidates(classes, tables, probes, block)).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    live = C.written(classes.select("h1", "h2", "cls", "many").join(near, "cls"), "vector-live")
    of_class = good.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    found = _links(C.written(live.join(of_class, ["h1", "h2"]).select("cls", "comp", "many", "v"), "vector-members"), cosine, block // 2)
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    tree = C.connected_components(found.where("up >= 0").select(F.col("cls").alias("a"), F.col("up").alias("b"))).select(F.col("node").alias("cls"), "root")
    linked = C.written(tree.join(classes.select("cls", "least"), "cls"), "vector-linked")
    tops = C.join_heavy(linked, linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    named = classes.join(degree, "cls", "left").join(tops, "cls", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    key = F.struct("h1", "h2").alias("key")
    linked = C.join_heavy(keyed.select("vec_id", key), C.written(named.select(key, "n_links", "component_id"), "vector-named"), "key").select("vec_id", "n_links", "component_id")
    alone = rows.where(v.isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings``: the vectors of its label at a cosine of 0.98 or more, and the smallest id that such links reach.

    Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing.
    """
    return embedding_duplicates(C.read(spark, sf_dir, "embeddings"))
