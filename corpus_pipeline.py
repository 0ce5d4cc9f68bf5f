"""Documents to packed training sequences: quality, line dedup, near-duplicates, decontamination, packing.

Each stage works on all that the one before it kept, and its result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import _common as C
from loomspan.llm.decontaminate import drop_contaminated
from loomspan.llm.lines import drop_boilerplate
from loomspan.llm.packing import pack
from loomspan.llm.quality import fit_quality, keep_quality
from loomspan.llm.simhash import near_duplicate_groups


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of good quality of at least one half; the others go."""
    return keep_quality(docs, fit_quality(docs, C.read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; lines seen on eight or more sources stay in the first document that has them."""
    return drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a shingle similarity of 0.8 or more stays: that with the smallest id.

    Rows are told apart by id and text, so another text under a repeated id is judged by its own group. Of rows equal in both
    one stays. Rows with a null id all stay.
    """
    first = near_duplicate_groups(docs).where("kept").select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_kept_hash")).distinct()
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    kept = rows.join(first, (F.col("doc_id") == F.col("_kept")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).drop("_hash").unionByName(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, C.read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]

#: a trained classifier, fingerprints and alignment cannot be said in SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read back."""
    docs, before = C.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with C.temporary_tables(spark) as tables:  # what the operators wrote goes when the stage's result is written
            docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            own = tables.pop()
            tables.extend(before or [])
            before = [own]
    return docs
