"""Mixing sources to target weights by Pareto order sampling.

A source's target says how often each of its words is to be read. A document's expected copies are its weight's share of that; their whole part
is certain, and the rest is its probability to be read once more. Pareto sampling ranks the documents of a source by random odds over inclusion odds,
and the first of them, as many as give the words still missing, are taken. The size that is fixed is the number of words: the document that would overshoot gives only its
first words, so a source's total is its target to the word.

The ranking never sorts a source: odds are counted into slots of the order, the slot that holds the end of the sample follows from a running sum over slots, and only its
documents, some ten thousand of any source, are ranked one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

WEIGHTS = (5, 2, 1)
SLOT_ROWS = 10_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A number between 0 and 1 (neither included) from the first 52 bits of an MD5 digest of the parts, so that reruns agree."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``sources`` (one row each: ``source, size``) with ``target``: by weight, ``share`` of all sizes in total, none above ``most`` times its size.

    Sources in the order of their code points, null last, have ``weights`` in turn. A source's target is the smaller of its cap and its weight times a common factor; each round
    gives the excess of capped sources to the others by weight, which raises the factor, until no more source reaches its cap.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    weight = F.lit([float(w) for w in weights])[((F.row_number().over(ranked) - 1) % len(weights)).cast("int")]
    table = C.written(sources.withColumn("weight", weight).withColumn("cap", most * F.col("size")), "mix-sources")
    every = table.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    factor, before = (every.size or 0) * share / every.weight if every.weight else 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * factor
        now = table.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if now.n == before or not now.weight:
            break
        before, factor = now.n, (every.size * share - (now.cap or 0.0)) / now.weight
    return table.withColumn("target", F.least(F.col("cap"), F.col("weight") * factor)).drop("weight", "cap")


def expected_copies(classes: DataFrame, key: str, most: float = 3.0) -> DataFrame:
    """``classes`` (``key, weight, words, target``) with ``copies``: at most ``most``, else in proportion to the weight, so that copies times words sum to the target of each key.

    The largest weights reach the cap first, so the factor follows from running sums over a key's classes. A weight of zero has no copies unless nothing else can hold the target.
    """
    falling = Window.partitionBy(key).orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    rows = classes.withColumns({"_capped": F.sum("words").over(falling) - F.col("words"), "_left": F.sum(F.col("weight") * F.col("words")).over(whole) - F.sum(F.col("weight") * F.col("words")).over(falling) + F.col("weight") * F.col("words")})
    rows = rows.withColumn("_factor", F.try_divide(F.col("target") - most * F.col("_capped"), F.col("_left")))
    # the first class in falling order that does not reach the cap fixes the factor; classes before it are capped
    fits = F.when((F.col("_factor") * F.col("weight") <= most), F.struct((-F.col("weight")).alias("w"), F.col("_factor").alias("f")))
    rows = rows.withColumn("_fit", F.min(fits).over(whole))
    return rows.withColumn("copies", F.when(F.col("_fit").isNull() | (-F.col("weight") < F.col("_fit.w")), F.lit(most)).otherwise(F.col("weight") * F.col("_fit.f"))).drop("_capped", "_left", "_factor", "_fit")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, share: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """``id, size, source_size, target, taken``: one row for each row of ``docs``.

    ``taken``: the words that the mix reads of the document, repeats counted. The whole copies are ``taken`` div ``size``; a rest means its first words once more, for at most one
    document of a source. The words taken of a source sum to its target, rounded, and no document has more than ``most`` times its size.
    ``weight``: a non-negative number for each document (rounded to three significant digits, null: 0; default 1); within a source, expected copies are proportional to it up to ``most``.

    A null source is a source of its own. A null or empty text has size 0 and gives nothing; a source without words has target 0. Rows with equal ids draw apart if their texts
    differ; equal rows share their place and their order is arbitrary, so that the rows of the result are the same in any run. An empty table gives no rows.
    """
    w = F.lit(1.0) if weight is None else F.coalesce(F.greatest(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    if weight is not None:
        digits = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(w, F.lit(1e-300)))) - 2)
        w = F.when(w > 0, F.round(w / digits) * digits).otherwise(0.0)
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), n_words(text_col).alias("size"), F.struct(key.alias("source"), w.alias("weight")).alias("class"), draw(F.lit(seed), F.col(id_col), F.col(text_col)).alias("u"))
    rows = C.written(rows, "mix-rows")
    classes = C.written(rows.groupBy("class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).select("class.*", "class", "words", "n"), "mix-classes")
    name = F.when(F.col("source") != "n", F.substring("source", 2, 2**30)).alias("source")
    sources = classes.groupBy("source").agg(F.sum("words").alias("size")).select(F.col("source").alias("key"), name, "size")
    targets = source_targets(sources.select("key", "source", "size"), weights, most, share)
    shares = expected_copies(classes.join(targets.select(F.col("key").alias("source"), F.col("size").alias("source_size"), "target"), "source"), "source", most)
    whole = F.floor(F.col("copies")).cast("long")
    shares = shares.withColumns({"whole": whole, "chance": F.col("copies") - whole})
    held = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    shares = shares.withColumn("missing", F.round(F.col("target")).cast("long") - held)
    shares = C.written(shares.select("class", "source_size", "target", "whole", "chance", "missing"), "mix-shares")

    # Pareto: odds of the draw over odds of inclusion, as a place between 0 and 1; near the end of the sample, at a half, places lie no closer than draws do
    rows = C.join_heavy(rows, shares, "class")
    odds = F.col("u") / (1 - F.col("u")) * ((1 - F.col("chance")) / F.col("chance"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    slots = max(1, -(-total // SLOT_ROWS))
    place = F.when(F.col("chance") > 0, odds / (1 + odds)).otherwise(1.0)
    rows = rows.withColumn("source", F.col("class.source")).withColumn("place", place).withColumn("slot", F.floor(F.col("place") * slots)).drop("class", "u", "chance")
    rows = C.written(rows, "mix-places")
    filled = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    filled = filled.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    # of the slots that the sample reaches the last one is where it ends; where it takes every word there is none
    ends = filled.where((F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing"))).select("source", F.col("slot").alias("end"), "before")
    ends = C.written(filled.select("source").distinct().join(ends, "source", "left"), "mix-ends")
    rows = C.join_heavy(rows, ends, "source")
    out = ["id", "size", "source_size", "target", "taken"]
    certain = F.col("whole") * F.col("size")
    at_end = F.coalesce(F.col("slot") == F.col("end"), F.lit(False))
    others = rows.where(~at_end).withColumn("taken", certain + F.when((F.col("missing") > 0) & (F.col("slot") < F.coalesce("end", F.lit(slots + 1))), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("missing") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    last = rows.where(at_end).withColumn("taken", certain + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return others.select(out).unionByName(last.select(out))


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes of it; sources weigh 5, 2, 1 in turn.

    Null and empty texts give nothing, a null source is the last source, equal rows share their place, and an empty table gives no rows.
    """
    return mix(C.read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::DOUBLE AS cap, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM sources
), factors AS (
  SELECT a.i, ((SELECT sum(source_size) FROM ordered) - coalesce(sum(b.cap) FILTER (b.i < a.i), 0)) / sum(b.weight) FILTER (b.i >= a.i) AS factor, any_value(a.cap / a.weight) AS bound
  FROM ordered a, ordered b GROUP BY a.i
), factor AS (
  SELECT coalesce(arg_min(factor, i) FILTER (factor < bound), 1e300) AS factor FROM factors
), targets AS (
  SELECT source, source_size, least(cap, weight * factor) AS target FROM sources, factor
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0 END AS copies, floor(CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0 END)::BIGINT AS whole FROM targets
), ranked AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole, round(s.target)::BIGINT - s.whole * s.source_size AS missing,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u / (1 - d.u) * ((1 - (s.copies - s.whole)) / (s.copies - s.whole)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, missing - before)))::BIGINT AS taken FROM ranked
"""
