"""Line dedup by distinct-site spread, with DataFrame functions only.

A line is known by two hashes. A HyperLogLog sketch of its sites merges by aggregation, so a line that a third of all rows
hold is combined inside each task before the shuffle. Lines whose estimate is near the threshold get an exact distinct count;
the others are decided by the estimate, whose error is far smaller than the distance. Lines of enough sites are
boilerplate and go from every document but the first that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _line_keys(line) -> list:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), F.length(line), line).alias("h2")]


def boilerplate_lines(docs: DataFrame, min_sites: int = 8, near: float = 0.25, lg_k: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``h1, h2, first_doc``: lines, of at least one character besides white space, seen on ``min_sites`` or more sites.

    ``near``: estimates within this share of the threshold are replaced with exact counts. ``first_doc`` is the smallest
    id that has the line (null only if all its ids are null). Null sites count as no site.
    """
    line = F.explode(F.split(text_col, "\n")).alias("line")
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"), line)
    lines = lines.where(F.trim("line") != "").select(*_line_keys(F.col("line")), "doc", "site")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc").alias("first_doc"))
    spread = spread.select("h1", "h2", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - near))
    spread = C.written(spread, "line-spread")
    close = F.col("sites") <= min_sites * (1 + near)
    exact = lines.join(spread.where(close).select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact"))
    sure = spread.where(~close).select("h1", "h2", "first_doc")
    near_ones = spread.where(close).join(exact.where(F.col("exact") >= min_sites), ["h1", "h2"]).select("h1", "h2", "first_doc")
    return C.written(sure.unionByName(near_ones), "boilerplate")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with boilerplate lines gone from every document but the line's first; the columns are unchanged.

    A text without such a line keeps its very characters, and a null text stays null; a text that is all boilerplate becomes empty and
    its row stays. ``n_chars`` is counted anew where it exists. Rows of one id share their fate line by line; rows with a null id
    lose every boilerplate line, unless no other id has it. Blank lines are never boilerplate.
    """
    bad = boilerplate_lines(docs, id_col=id_col, text_col=text_col, **options)
    line = F.explode(F.split(text_col, "\n")).alias("line")
    held = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), line).select("doc", *_line_keys(F.col("line")))
    hit = held.join(bad, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first_doc")))
    gone = hit.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("_gone")).select(F.col("doc").alias("_doc"), "_gone")
    kept = F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(F.col("_gone"), F.struct(*_line_keys(x))))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = docs.join(gone, F.col("_doc").eqNullSafe(F.col(id_col)), "left").withColumn(text_col, text)
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(dict(docs.dtypes)[n_chars_col]))
    return out.select(*docs.columns)


def op9_lines(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the digest and length of its cleaned text; a null text stays null."""
    cleaned = drop_boilerplate(C.read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, source, s.i, s.line
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) s
  WHERE text IS NOT NULL
), bad AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= 8
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN bad b ON l.line = b.line
  WHERE b.line IS NULL OR b.first_doc = l.doc_id
  GROUP BY l.doc_id
)
SELECT d.doc_id, md5(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS text_md5, length(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
