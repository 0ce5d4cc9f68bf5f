"""SimHash near-dedup: exact Hamming-radius links through vantage-point trees.

A tree over all 64 bits prunes little: the distances of unrelated fingerprints lie within a few bits of 32, about as
wide as the radius. So the fingerprint is cut into ``bands`` of 16 bits. A pair within radius r agrees to within
r // 4 bits in at least one band, and there a vantage-point tree with that smaller radius separates well. Each tree
is built from the exact counts of the band's values (at most 65,536 for any corpus). A leaf is a shard. A fingerprint's
home is one leaf; by the triangle bound it is sent, as a visitor, to the leaves that may hold a home within the radius
on the far side of a vantage boundary. Leaves with many homes or visitors are cut into blocks of both, and each block of homes meets
each block of either in a task of its own, so a shard is bounded. Inside a shard only band values within the radius of each other meet, and
they are measured over all bits. Shards emit a spanning forest of their links, never all pairs of a group of copies, and a
distributed contraction joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .forest import Forest
from .hashing import SPACES, low_bytes, shingles_of, word_hashes

BANDS, BITS = 4, 16
_BYTE_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype(float)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    found = low_bytes(text).split()  # bytes: ASCII white space only
    if not found:
        return 0
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined = b" ".join(found)
    k = min(words, len(found))
    first, last = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, step = np.zeros((8, 256), np.int64), 100_000
    for at in range(0, len(first), step):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[at : at + step], last[at : at + step])], dtype="<u8")
        counts += np.bincount((h.view("u1").reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BYTE_BITS) > len(first)).astype("u1").ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: each row's fingerprint as a signed 64-bit number."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """A vantage-point tree over the values of one band, each with the number of fingerprints that have it."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, radius: int, leaf: int):
        self.radius, self.leaf, self.sizes = radius, leaf, []
        self.root = self._grow(values.astype(np.uint16), counts.astype(np.int64), np.random.default_rng(7))

    def _grow(self, values, counts, rng):
        total = int(counts.sum())
        best = None
        if total > self.leaf and len(values) > 1:
            for v in rng.choice(values, min(12, len(values)), replace=False):
                held = np.bincount(np.bitwise_count(values ^ v), counts, BITS + 2)
                inside = np.cumsum(held)
                for mu in range(BITS):
                    near, far = inside[mu], total - inside[mu]
                    if near and far:
                        visit = inside[mu] - (inside[mu - self.radius] if mu >= self.radius else 0)
                        cost = near * near + far * far + 2 * far * visit
                        if best is None or cost < best[0]:
                            best = (cost, v, mu)
        if best is None or best[0] > 0.97 * total * total:
            self.sizes.append(total)
            return len(self.sizes) - 1
        _, v, mu = best
        near = np.bitwise_count(values ^ v) <= mu
        return v, mu, self._grow(values[near], counts[near], rng), self._grow(values[~near], counts[~near], rng)

    def route(self, values: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(leaf, home, rows): every pair within the radius meets in the home leaf of one of the two."""
        todo = [(self.root, np.arange(len(values)), np.zeros(0, np.int64))]
        while todo:
            node, home, away = todo.pop()
            if not len(home) and not len(away):
                continue
            if isinstance(node, int):
                yield node, True, home
                yield node, False, away
                continue
            v, mu, near, far = node
            d, e = np.bitwise_count(values[home] ^ v).astype(np.int64), np.bitwise_count(values[away] ^ v).astype(np.int64)
            r = self.radius
            todo.append((near, home[d <= mu], away[e <= mu + r]))
            todo.append((far, home[d > mu], np.concatenate([away[e > mu - r], home[(d <= mu) & (d > mu - r)]])))


class Shards:
    """Vantage-point trees over bands and the blocks that their leaves are cut into; what tasks need to deal fingerprints.

    ``held`` has, for each band, its values and the number of fingerprints with each of them.
    """

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]], radius: int, leaf: int, block: int):
        self.trees, self.cuts = [], []
        for values, counts in held:
            tree = VantageTree(values, counts, radius, leaf)
            visitors = np.zeros(len(tree.sizes), np.int64)
            for leaf_no, home, rows in tree.route(values.astype(np.uint16)):
                if not home:
                    visitors[leaf_no] += int(counts[rows].sum())
            homes = -(-np.maximum(np.array(tree.sizes, dtype=np.int64), 1) // block)
            self.trees.append(tree)
            self.cuts.append((homes, np.where((homes == 1) & (visitors <= 2 * block), 0, -(-visitors // block))))

    def deal(self, band: int, values: np.ndarray, deal_by: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(shard, home, rows). A shard is a block of homes and a block that meets it: itself, earlier homes, or visitors."""
        homes, visitors = self.cuts[band]
        for leaf_no, is_home, rows in self.trees[band].route(values):
            if not len(rows):
                continue
            h, v = int(homes[leaf_no]), int(visitors[leaf_no])
            key = (band << 56) + (leaf_no << 36)
            if h == 1 and not v:
                yield key, is_home, rows
                continue
            if is_home:
                own = deal_by[rows] % h
                for c in range(h):
                    mine = rows[own == c]
                    for moving in range(c, h + v):
                        yield key + (moving << 18) + c, True, mine
                    for fixed in range(c):
                        yield key + (c << 18) + fixed, False, mine
            else:
                own = deal_by[rows] % v
                for c in range(v):
                    mine = rows[own == c]
                    for fixed in range(h):
                        yield key + (h + c << 18) + fixed, False, mine


def band_counts(fps: DataFrame, places: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values and counts of each band, a column and the number of a 16-bit part: at most 65,536 rows for each."""
    parts = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(name, BITS * b).bitwiseAND(2**BITS - 1).cast("int").alias("value")) for k, (name, b) in enumerate(places)]
    held = fps.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.band", "p.value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    band, value, n = (held.column(c).to_numpy() for c in ("band", "value", "n"))
    out = []
    for k in range(len(places)):
        own = np.flatnonzero(band == k)
        own = own[np.argsort(value[own], kind="stable")]
        out.append((value[own].astype(np.int64), n[own].astype(np.int64)))
    return out


def near_values(values: np.ndarray, n: int, radius: int, most: int = 2**20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item, home) pairs of a shard whose band values differ in ``radius`` bits at most, in bounded parts.

    The first ``n`` items are homes. Two homes are a pair once, and no item is one with itself.
    """
    values = values.astype(np.int64)
    order = np.argsort(values[:n], kind="stable")
    held = values[:n][order]
    for flips in (f for k in range(radius + 1) for f in combinations(range(BITS), k)):
        want = values ^ sum(1 << f for f in flips)
        low, high = np.searchsorted(held, want, "left"), np.searchsorted(held, want, "right")
        rows = np.flatnonzero(high > low)
        ends = np.cumsum((high - low)[rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            own = rows[at:to]
            size = (high - low)[own]
            i = np.repeat(own, size)
            j = order[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - low[own], size)]
            use = (i >= n) | (j < i)
            yield i[use], j[use]
            at = to


def hamming_components(fps: DataFrame, radius: int = 4, leaf: int = 4000, block: int = 200_000) -> DataFrame:
    """``fp, root`` for fingerprints (column ``fp``, long) that link with others at ``radius`` or fewer bits.

    Fingerprints without a link may be absent. ``leaf`` is the number of homes at which a tree stops, ``block`` the number
    of homes or visitors above which a leaf is cut into several shards; neither changes the result.
    """
    spark = fps.sparkSession
    distinct = C.written(fps.select("fp").where(F.col("fp").isNotNull()).distinct(), "fingerprints")
    near = radius // BANDS
    sent = spark.sparkContext.broadcast(Shards(band_counts(distinct, [("fp", b) for b in range(BANDS)]), near, leaf, block))

    def send(batches: Iterator) -> Iterator:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            deal_by = (fp % np.uint64(1_000_003)).astype(np.int64)
            for b in range(BANDS):
                values = ((fp >> np.uint64(BITS * b)) & np.uint64(2**BITS - 1)).astype(np.uint16)
                out = [(np.full(len(rows), shard, np.int64), np.full(len(rows), home), fp[rows]) for shard, home, rows in sent.value.deal(b, values, deal_by)]
                shard, home, rows = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), pa.array(rows.view(np.int64))], names=["shard", "home", "fp"])

    def meet(table: pa.Table) -> pa.Table:
        home, fp = table.column("home").to_numpy(zero_copy_only=False), table.column("fp").to_numpy().view(np.uint64)
        items, n, band = np.concatenate([fp[home], fp[~home]]), int(home.sum()), table.column("shard")[0].as_py() >> 56
        forest = Forest(len(items))
        for i, j in near_values((items >> np.uint64(BITS * band)) & np.uint64(2**BITS - 1), n, near):
            close = (np.bitwise_count(items[i] ^ items[j]) <= radius) & (forest.label[i] != forest.label[j])
            forest.add(i[close], j[close])
        a, b = (items[x].view(np.int64) for x in forest.roots())
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    edges = distinct.mapInArrow(send, "shard long, home boolean, fp long").groupBy("shard").applyInArrow(meet, "a long, b long")
    found = C.connected_components(edges)
    return found.select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``; component_id is the smallest id reachable.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated ids give
    repeated rows. Null ids are kept; a component of null ids only has a null component_id. An empty table gives no rows.
    """
    fps = C.written(fingerprints(docs, id_col, text_col), "doc-fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = hamming_components(fps, radius, **sizes)
    linked = C.written(least.join(links, "fp").select("fp", "root", "least"), "linked-fingerprints")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = C.join_heavy(linked, of_root, "root").select("fp", "component_id")
    named = C.written(least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fingerprint-components")
    return C.join_heavy(fps, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its fingerprint and the smallest id that links of four or fewer bits reach.

    Null, empty and blank texts have fingerprint zero and link like any other; repeated rows and null ids are kept; other columns are not read.
    """
    return simhash_groups(C.read(spark, sf_dir, "documents"))


# Wide fingerprints: near-duplicates at a similarity of 0.8 of five-word shingles.
#
# At that similarity a 64-bit fingerprint differs in about ten bits, too noisy a measure and too large a radius for any
# tree. Four words with the hash's four seeds differ in 39 of 256 bits on average (standard deviation 6). Fingerprints only name
# candidates: pairs within 58 bits (three deviations more) that are within one bit in any of the sixteen 16-bit bands, by
# expectation 0.99 of isolated pairs at 0.8 and more above it. A link is a candidate whose shingle sets have a measured
# Jaccard similarity of 0.8 or more.

WIDE, WIDE_RADIUS, SIMILAR = 4, 58, 0.8


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; a shorter text is one shingle."""
    found = word_hashes(low_bytes(text), SPACES)[0]
    return np.unique(shingles_of(found, min(words, len(found)))) if len(found) else np.zeros(0, np.uint64)


def _wide_of(hashes: np.ndarray) -> tuple[int, ...]:
    if not len(hashes):
        return (0,) * WIDE
    counts, step, place = np.zeros((WIDE, 2048), np.int64), 100_000, np.arange(8) * 256
    for at in range(0, len(hashes), step):
        h = hashes[at : at + step]
        for w in range(WIDE):
            mixed = h
            if w:
                mixed = (h ^ (h >> np.uint64(29 + w))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * w)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB + 2 * w)
                mixed = mixed ^ (mixed >> np.uint64(29))
            counts[w] += np.bincount((mixed.view("u1").reshape(-1, 8) + place).ravel(), minlength=2048)
    bits = (2 * (counts.reshape(WIDE * 8, 256) @ _BYTE_BITS) > len(hashes)).astype("u1").reshape(WIDE, 64)
    return tuple(int(x) for x in np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel())


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[int, ...]:
    """Four fingerprints, of the distinct shingles' XXH64 and of three multiplicative mixes of it."""
    return _wide_of(shingle_hashes(text, words))


def _wide_pairs(items: np.ndarray, sizes: np.ndarray, values: np.ndarray, forest: Forest, n: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (item, home) of different trees, closest first in each run; the first ``n`` items are homes.

    A pair whose numbers of shingles rule out a Jaccard similarity of SIMILAR is none.
    """
    for i, j in near_values(values, n, 1, 2**18):
        label = forest.label
        use = (label[i] != label[j]) & (np.minimum(sizes[i], sizes[j]) >= SIMILAR * np.maximum(sizes[i], sizes[j]))
        i, j = i[use], j[use]
        bits = np.bitwise_count(items[i] ^ items[j]).sum(1, dtype=np.int64)
        order = np.flatnonzero(bits <= radius)
        order = order[np.argsort(bits[order], kind="stable")]
        if len(order):
            yield i[order], j[order]


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def _sets_of(nodes: DataFrame, classes: DataFrame, fps: DataFrame) -> DataFrame:
    """``node, shingles`` of distinct nodes, from one row of ``fps`` for each, so that no row of a copy is moved for another."""
    rows = classes.select("node", "row").join(nodes, "node", "left_semi")
    return fps.select("row", "shingles").join(rows, "row").select("node", "shingles")


def _measured(pairs: DataFrame, classes: DataFrame, fps: DataFrame) -> DataFrame:
    """``a, b, similar``: whether the shingle sets of two classes have a Jaccard similarity of SIMILAR or more.

    A shingle counts by 32 bits of its hash, so that two of a text of n shingles are one with a probability of n / 2^33.
    """

    def compare(batches: Iterator) -> Iterator:
        for batch in batches:
            out = [_similar(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.bool_())], names=["a", "b", "similar"])

    sets = C.written(_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, fps), "wide-sets")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    out = C.written(two.mapInArrow(compare, "a long, b long, similar boolean"), "wide-measured")
    C.drop_written(sets)
    return out


def _torn_links(torn: DataFrame, trees_of: DataFrame, links: DataFrame, classes: DataFrame, fps: DataFrame, radius: int, block: int) -> DataFrame:
    """``a, b``: links that join the parts into which refused links have torn trees of candidates.

    Both ends of such a link lie in one tree. All texts of a tree meet those that are not in its largest part, a block of the one with a block of
    the other in a task, and there every pair of different parts within the radius is measured until it joins them or is refused.
    """
    parts = C.written(trees_of.join(C.connected_components(links), "node", "left").select("node", "tree", F.coalesce("root", "node").alias("part")), "wide-parts")
    sizes = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("tree").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("main"))
    sizes = sizes.join(torn, "tree", "left_semi").select("tree", F.col("main.part").alias("main"), F.ceil(F.col("n") / block).alias("all"), F.ceil((F.col("n") - F.col("main.n")) / block).alias("few"))
    dealt = C.join_heavy(parts, C.written(sizes, "wide-torn"), "tree").where("few > 0")
    cut = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    moving = dealt.select("node", "tree", "part", F.lit(False).alias("fixed"), cut(1, "all").alias("m"), every("few").alias("f"))
    fixed = dealt.where("part <> main").select("node", "tree", "part", F.lit(True).alias("fixed"), cut(2, "few").alias("f"), every("all").alias("m"))
    names = [f"f{w}" for w in range(WIDE)]
    nodes = C.written(dealt.select("node"), "wide-torn-nodes")
    held = classes.select("node", "size", *names).join(_sets_of(nodes, classes, fps), "node")

    def meet(table: pa.Table) -> pa.Table:
        fixed = table.column("fixed").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(fixed), np.flatnonzero(~fixed)])
        node, size, part = (table.column(c).to_numpy()[order] for c in ("node", "size", "part"))
        fp = np.stack([table.column(c).to_numpy()[order] for c in names], 1).view(np.uint64)
        sets = [np.frombuffer(x, "<u4") for x in table.column("shingles").take(pa.array(order)).to_pylist()]
        forest, n, out = Forest(len(order)), int(fixed.sum()), []
        forest.label = np.unique(part, return_inverse=True)[1]
        for at in range(n, len(order), 256):
            bits = sum(np.bitwise_count(fp[at : at + 256, None, w] ^ fp[None, :n, w]).astype(np.int16) for w in range(WIDE))
            i, j = np.nonzero((bits <= radius) & (forest.label[at : at + 256, None] != forest.label[None, :n]))
            for k in np.argsort(bits[i, j], kind="stable").tolist():
                x, y = int(i[k]) + at, int(j[k])
                if forest.label[x] != forest.label[y] and min(size[x], size[y]) >= SIMILAR * max(size[x], size[y]) and _similar(sets[x], sets[y]):
                    forest.add(np.array([x]), np.array([y]))
                    out.append((node[x], node[y]))
        a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return moving.unionByName(fixed).join(held, "node").groupBy("tree", "f", "m").applyInArrow(meet, "a long, b long")


def near_duplicate_groups(docs: DataFrame, words: int = 5, radius: int = WIDE_RADIUS, leaf: int = 4000, block: int = 100_000, torn_block: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, component_id, kept``: one row per row of ``docs``.

    Groups are the components of links between texts whose five-word shingles, each counted once, have a Jaccard similarity of 0.8 or
    more; wide fingerprints find the candidates and every link is measured. Null and empty texts are one group. ``component_id`` is the
    smallest id of the group; null ids are kept. ``text_hash`` tells rows of one id apart. ``kept`` marks the group's row of the smallest
    id and, of several texts under it, the smallest hash; it is false for null ids. An empty table gives no rows; ``leaf`` and the blocks
    do not change the result.

    Shards first emit a spanning forest of their candidates, never all pairs of a group of copies. Where the measure refuses a
    link of a tree, the tree's texts meet again (:func:`_torn_links`), and only links that join two parts leave a task.
    """
    from xxhash import xxh64_intdigest

    spark = docs.sparkSession
    names = [f"f{w}" for w in range(WIDE)]
    columns = ["node", "size", *names]
    types = ", ".join(f"{c} long" for c in columns)

    def prints(batches: Iterator) -> Iterator:
        for batch in batches:
            sets = [shingle_hashes(x.as_py(), words) for x in batch.column(2)]
            found = np.array([_wide_of(h) for h in sets], dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            node = np.array([xxh64_intdigest(h.tobytes(), 42) for h in sets], dtype=np.uint64).view(np.int64)
            held = [np.unique(h.astype("<u4")).tobytes() for h in sets]
            arrays = [pa.array(node), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(c) for c in found.T), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["doc_id", "text_hash", "node", "size", *names, "shingles"])

    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col).cast("string"))
    fps = C.written(rows.mapInArrow(prints, "doc_id long, text_hash long, node long, size long, " + ", ".join(f"{c} long" for c in names) + ", shingles binary").withColumn("row", F.monotonically_increasing_id()), "wide-fingerprints")
    classes = C.written(fps.groupBy("node", "size", *names).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("least"), F.min("row").alias("row")), "wide-classes")
    places = [(w, b) for b in range(BANDS) for w in range(WIDE)]
    sent = spark.sparkContext.broadcast(Shards(band_counts(classes, [(names[w], b) for w, b in places]), 1, leaf, block))

    def send(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            fp = np.stack([c.to_numpy() for c in batch.columns[2:]], 1).view(np.uint64)
            for k, (w, b) in enumerate(places):
                values = ((fp[:, w] >> np.uint64(BITS * b)) & np.uint64(2**BITS - 1)).astype(np.uint16)
                out = [(np.full(len(rows), shard, np.int64), np.full(len(rows), home), rows) for shard, home, rows in sent.value.deal(k, values, np.abs(node % 1_000_003))]
                shard, home, rows = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), *(c.take(pa.array(rows)) for c in batch.columns)], names=["shard", "home", *columns])

    def meet(table: pa.Table) -> pa.Table:
        """A spanning forest of a shard's candidates."""
        home = table.column("home").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
        node, size = (table.column(c).to_numpy()[order] for c in columns[:2])
        fp = np.stack([table.column(c).to_numpy()[order] for c in names], 1).view(np.uint64)
        w, b = places[table.column("shard")[0].as_py() >> 56]
        values = (fp[:, w] >> np.uint64(BITS * b)) & np.uint64(2**BITS - 1)
        forest, out = Forest(len(order)), [np.zeros((2, 0), np.int64)]
        for i, j in _wide_pairs(fp, size, values, forest, int(home.sum()), radius):
            used = forest.add(i, j)
            out.append(np.stack([node[i[used]], node[j[used]]]))
        a, b = np.concatenate(out, 1)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    shards = classes.select(*columns).mapInArrow(send, f"shard long, home boolean, {types}").groupBy("shard")
    first = C.written(shards.applyInArrow(meet, "a long, b long").distinct(), "wide-candidates")
    measured = _measured(first, classes, fps)
    links = measured.where("similar").select("a", "b")
    if not measured.where("NOT similar").isEmpty():
        trees_of = C.connected_components(first).withColumnRenamed("root", "tree")
        torn = measured.where("NOT similar").join(trees_of, F.col("a") == F.col("node")).select("tree").distinct()
        links = links.unionByName(C.written(_torn_links(torn, trees_of, links, classes, fps, radius, torn_block), "wide-torn-links"))
    roots = C.connected_components(links)
    linked = C.written(classes.join(roots, "node").select("node", "least", "root"), "wide-linked")
    least = C.join_heavy(linked, linked.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first")
    first = F.coalesce("first", "least").alias("first")
    named = classes.join(least, "node", "left").select("node", first).select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
    kept = F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")), F.lit(False))
    rows = C.join_heavy(fps.select("doc_id", "text_hash", "node"), C.written(named, "wide-named"), "node")
    return rows.select("doc_id", "text_hash", "component_id", kept.alias("kept"))
