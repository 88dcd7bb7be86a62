"""Raw documents to packed training sequences: quality, line dedup, near-dedup, decontamination, packing.

Each stage gives its operator's results for nulls, empty and very long texts, ties and repeats: a null text is an empty one, an empty or
blank text passes unless the classifier rejects it, a null doc_id is a document of its own, rows that repeat a doc_id and a
text are one from the near-duplicates on, and an empty table gives an empty one. Columns of any name and type pass through all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm import decontamination, lines, minhash, packing, quality
from cantora.llm.common import Scratch, bounded, fresh, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    (name,) = fresh(docs, "_quality")
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).where(F.col(name) >= quality.CUT).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing but blank lines is left go.

    Long lines need as many documents as others here: near-copies would come to the next stage as pieces that it can't know."""
    (dropped,) = fresh(docs, "_n_dropped")
    out = lines.drop_recurring_lines(docs, long_docs=lines.MIN_DOCS).where((F.col(dropped) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows that repeat a doc_id and a text, one."""
    found = Scratch(spark).keep(minhash.near_rows(docs), "near")
    rows, different = found.agg(F.count("*"), F.countDistinct(F.struct("doc_id", "text_key"))).first()
    d, t, key = fresh(docs, "_d", "_t", "_key")
    drop = bounded(found.where("not head").select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    out = docs.join(drop, same, "left_anti").select(*docs.columns)
    if rows > different:
        out = out.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
    return out


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminated window."""
    d, t = fresh(docs, "_d", "_t")
    found = decontamination.contaminated_windows(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    found = bounded(Scratch(spark).keep(found, "contaminated"))
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's input goes, with what the stage wrote meanwhile, as soon as its result is written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with Scratch.scope():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
