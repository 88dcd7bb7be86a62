"""Quality of a transcription against a recording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators import temporal


def onset_scores(heard: DataFrame, written: DataFrame, tolerance: float, at: str = "t") -> DataFrame:
    """Precision, recall and F1 a file. A heard onset counts once, for the written ones whose nearest it is."""
    near = temporal.nearest(written, heard, at=at, tolerance=tolerance)
    hits = near.groupBy("file_id").agg(F.countDistinct("nearest").alias("hits"), F.count("*").alias("written"))
    there = heard.groupBy("file_id").agg(F.count("*").alias("heard"))
    rows = hits.join(there, "file_id", "full").na.fill(0, ["hits", "written", "heard"])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    rows = rows.withColumn("precision", ratio(F.col("hits"), F.col("written"))).withColumn("recall", ratio(F.col("hits"), F.col("heard")))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def intervals(onsets: DataFrame, at: str = "t") -> DataFrame:
    """Inter-onset intervals, as shares of a file's largest; files without a positive one have none."""
    rows = onsets.select("file_id", (F.col(at) - F.lag(at).over(Window.partitionBy("file_id").orderBy(at))).alias("v")).where("v is not null")
    top = F.max("v").over(Window.partitionBy("file_id"))
    return rows.withColumn("_top", top).where("_top > 0").select("file_id", (F.col("v") / F.col("_top")).alias("v"))


def rhythm_precision(heard: DataFrame, written: DataFrame, at: str = "t") -> DataFrame:
    """1 less the distance of the interval distributions; 0.5 where either has none."""
    a, b = intervals(heard, at), intervals(written, at)
    both = a.select("file_id").distinct().join(b.select("file_id").distinct(), "file_id")
    far = temporal.wasserstein(a.join(both, "file_id"), b.join(both, "file_id"))
    files = heard.select("file_id").unionByName(written.select("file_id")).distinct()
    return files.join(far, "file_id", "left").select("file_id", F.when(F.col("distance").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("distance"))).alias("rhythm"))


def polyphony(notes: DataFrame, points: int = 100) -> DataFrame:
    """Number of sounding notes on an even grid of each file."""
    bounds = notes.groupBy("file_id").agg(F.max("end_tick").alias("end"))
    return temporal.count_covering(temporal.even_grid(bounds, F.lit(points)), notes)


def polyphony_score(grid: DataFrame) -> DataFrame:
    mean = F.avg("n")
    return grid.groupBy("file_id").agg(mean.alias("mean")).withColumn("score", F.when(F.col("mean").between(2, 6), 0.9).when(F.col("mean").between(1, 8), 0.7).otherwise(0.5))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def chroma_similarity(a: DataFrame, b: DataFrame, value: str = "c") -> DataFrame:
    """Mean cosine of frames at equal places, negative ones as 0, undefined ones left out; 0 without any."""
    both = a.select("file_id", "frame", F.col(value).alias("_a")).join(b.select("file_id", "frame", F.col(value).alias("_b")), ["file_id", "frame"])
    return both.groupBy("file_id").agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), cosine(F.col("_a"), F.col("_b")))), F.lit(0.0)).alias("chroma"))


def pitch_accuracy(notes: DataFrame) -> DataFrame:
    """The constant that stands for an unmeasured accuracy: 0.85 where there are notes."""
    return notes.select("file_id").distinct().withColumn("pitch", F.lit(0.85))


def report(scores: DataFrame) -> DataFrame:
    """file_id, text of the five measures, the overall score and its rating, of what overall() gives."""
    rule = "\u2500" * 37
    line = lambda title, value: F.format_string(f"{title + ':':<23}%.1f%%", 100 * F.col(value))
    parts = [line("Onset F1 Score", "f1"), line("Pitch Accuracy", "pitch"), line("Spectral Similarity", "chroma"), line("Polyphony Score", "polyphony"), line("Rhythmic Precision", "rhythm")]
    text = F.concat_ws("\n", F.lit("Quality Report:"), F.lit(rule), *parts, F.lit(rule), line("Overall Quality", "score"), F.concat(F.lit("Rating: "), "rating"))
    return scores.select("file_id", text.alias("text"))


def overall(f1: DataFrame, pitch: DataFrame, chroma: DataFrame, poly: DataFrame, rhythm: DataFrame) -> DataFrame:
    """One row a file: the five measures, their weighted sum and its rating."""
    measures = {"f1": f1, "pitch": pitch, "chroma": chroma, "polyphony": poly.withColumnRenamed("score", "polyphony"), "rhythm": rhythm}
    one = lambda name, rows: rows.select("file_id", *((F.col(c) if c == name else F.lit(None)).cast("double").alias(c) for c in measures))
    rows = reduce(DataFrame.unionByName, (one(*m) for m in measures.items())).groupBy("file_id").agg(*(F.max(c).alias(c) for c in measures))
    rows = rows.na.fill(0.0, ["f1", "pitch", "chroma", "polyphony"]).na.fill(0.5, ["rhythm"])
    rows = rows.withColumn("score", M.overall_score(*(F.col(c) for c in ("f1", "pitch", "chroma", "polyphony", "rhythm"))))
    return rows.withColumn("rating", M.rating(F.col("score")))
