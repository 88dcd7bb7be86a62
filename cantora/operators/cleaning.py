"""Correction of transcribed notes: rules, grid, merging, key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators import temporal


def with_reason(notes: DataFrame, min_velocity: int = 15, min_ms: float = 50, ms_per_tick: float | None = None) -> DataFrame:
    """The first rule that a note breaks: quiet, range, short; else kept."""
    per = ms_per_tick or M.ms_per_tick()
    reason = F.when(F.col("velocity") < min_velocity, "quiet").when(~F.col("pitch").between(M.LOW, M.HIGH), "range").when(F.col("dur_ticks") * F.lit(per) < min_ms, "short").otherwise("kept")
    return notes.withColumn("reason", reason)


def kept_notes(notes: DataFrame, **rules) -> DataFrame:
    return with_reason(notes, **rules).where("reason = 'kept'").drop("reason")


def drop_short(notes: DataFrame, ms_per_tick: float = 2.3, least_ms: float = 50) -> DataFrame:
    return notes.where(F.col("dur_ticks") * F.lit(ms_per_tick) >= least_ms)


def extend(notes: DataFrame, min_ms: float = 120) -> DataFrame:
    """Shorter notes last min_ms; ends become doubles."""
    least = F.lit(min_ms / M.ms_per_tick())
    dur = F.greatest(F.col("dur_ticks").cast("double"), least)
    return notes.withColumn("dur", dur).withColumn("end", F.col("start_tick") + dur)


def quantise(extended: DataFrame, resolution: int = 16, strength: float = 0.5) -> DataFrame:
    begin, end = M.quantise(F.col("start_tick"), F.col("dur"), resolution=resolution, strength=strength)
    return extended.withColumn("end_tick", end).withColumn("start_tick", begin).withColumn("dur_ticks", F.col("end_tick") - F.col("start_tick"))


def legato_islands(notes: DataFrame, within_ms: float = 50, merge_by: tuple[str, ...] = ("pitch",)) -> DataFrame:
    """Notes with the island of notes that follow each other within the gap; an overlap breaks it. Tracks are ignored by default."""
    keys = ["file_id", *merge_by]
    gap = F.col("start_tick") - F.lag("end_tick").over(Window.partitionBy(*keys).orderBy("start_tick", "note_id"))
    rows = notes.withColumn("_gap", gap)
    return temporal.islands(rows, keys, ["start_tick", "note_id"], F.col("_gap").between(0, int(within_ms / M.ms_per_tick() + 1e-9))).drop("_gap")


def merge_legato(notes: DataFrame, within_ms: float = 50, merge_by: tuple[str, ...] = ("pitch",)) -> DataFrame:
    """One note an island: the first's start and track, the last's end, velocity folded pair by pair with truncation."""
    rows = legato_islands(notes, within_ms, merge_by)
    row = F.struct("start_tick", "note_id", "velocity", "track", "channel", "end_tick")
    merged = rows.groupBy("file_id", *merge_by, "island").agg(F.array_sort(F.collect_list(row)).alias("all"))
    velocity = F.aggregate("all", F.lit(None).cast("int"), lambda acc, x: F.when(acc.isNull(), x["velocity"]).otherwise(((acc + x["velocity"]) / 2).cast("int")))
    first, last = F.element_at("all", 1), F.element_at("all", -1)
    return merged.select("file_id", *merge_by, first["note_id"].alias("note_id"), first["track"].alias("track"), first["channel"].alias("channel"), first["start_tick"].alias("start_tick"), last["end_tick"].alias("end_tick"), velocity.alias("velocity"), F.size("all").alias("merged"))


def merge_rapid(notes: DataFrame, least_ms: float = 30, ms_per_tick: float = 2.3) -> DataFrame:
    """Rapid repeats joined two by two within a track: the first's start, velocity and channel, the second's end."""
    keys, order = ["file_id", "track", "pitch"], ["start_tick", "note_id"]
    gap = F.col("start_tick") - F.lag("end_tick").over(Window.partitionBy(*keys).orderBy(*order))
    rows = temporal.rapid_pairs(notes.withColumn("_gap", gap), keys, order, F.col("_gap") * F.lit(ms_per_tick) < least_ms)
    at = F.struct("start_tick", "note_id")
    return rows.groupBy(*keys, "island", "pair").agg(F.min("start_tick").alias("start_tick"), F.max_by("end_tick", at).alias("end_tick"), F.min_by("velocity", at).alias("velocity"), F.min_by("channel", at).alias("channel"), F.count("*").alias("joined")).drop("island", "pair")


def correction_stats(notes: DataFrame, min_ms: float = 120, within_ms: float = 50) -> DataFrame:
    """Counters of a correction run, a row a file. merged: kept notes that join the one before them."""
    rows = with_reason(notes).withColumn("_kept", F.col("reason") == "kept")
    gap = F.col("start_tick") - F.lag("end_tick").over(Window.partitionBy("file_id", "pitch", "_kept").orderBy("start_tick", "note_id"))
    return rows.withColumn("_joins", F.col("_kept") & gap.between(0, int(within_ms / M.ms_per_tick() + 1e-9))).groupBy("file_id").agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("reason") == r).alias(f"removed_{r}") for r in ("quiet", "range", "short")),
        F.count_if(F.col("_kept") & (F.col("dur_ticks") * F.lit(M.ms_per_tick()) < min_ms)).alias("extended"),
        F.count_if("_joins").alias("merged"),
    )


def pitch_class_histogram(notes: DataFrame) -> DataFrame:
    """file_id, hist: shares of the twelve pitch classes."""
    n = F.count("*")
    pc = M.pitch_class(F.col("pitch"))
    return notes.groupBy("file_id").agg(F.array(*(F.count_if(pc == k) / n for k in range(12))).alias("hist"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of two arrays, 0 if one is constant."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    dx, dy = F.transform(x, lambda v: v - mean(x)), F.transform(y, lambda v: v - mean(y))
    below = F.sqrt(dot(dx, dx) * dot(dy, dy))
    return F.when(below == 0, 0.0).otherwise(dot(dx, dy) / below)


def detect_key(notes: DataFrame, fixed: bool = False) -> DataFrame:
    """The best of 24 keys a file; ties to the lower root, major first. Without ``fixed`` the inverse root is named."""
    keys = M.key_profiles(notes.sparkSession, fixed)
    rows = pitch_class_histogram(notes).crossJoin(F.broadcast(keys)).withColumn("r", F.round(correlation(F.col("hist"), F.col("profile")), 9))  # 24 rows
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("r"), "root", "m_ord"))
    return rows.withColumn("_nth", nth).where("_nth = 1").select("file_id", "root", "mode", F.round("r", 6).alias("r"), "scale_mask")


def flag_out_of_key(notes: DataFrame, keys: DataFrame) -> DataFrame:
    mask = F.element_at(F.array(*(F.lit(1 << k) for k in range(12))), M.pitch_class(F.col("pitch")) + 1)
    return notes.join(keys.select("file_id", "scale_mask"), "file_id").withColumn("out_of_key", F.col("scale_mask").bitwiseAND(mask) == 0).drop("scale_mask")


def correct(notes: DataFrame, min_ms: float = 120, quantize: bool = True, resolution: int = 16, merge: bool = True, within_ms: float = 50) -> DataFrame:
    """The whole chain: rules, extension, grid, merging."""
    rows = extend(kept_notes(notes), min_ms)
    rows = quantise(rows, resolution) if quantize else rows.withColumn("end_tick", F.col("end").cast("long"))
    return merge_legato(rows, within_ms) if merge else rows
