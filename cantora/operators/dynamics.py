"""Velocities, pedal and timing from frame features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators import temporal

EPS = 1e-8


def minmax(df: DataFrame, value: str, name: str, key: str = "file_id") -> DataFrame:
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, (F.col(value) - low) / (high - low + F.lit(EPS)))


def zscore(df: DataFrame, value: str, name: str, key: str = "file_id") -> DataFrame:
    w = Window.partitionBy(key)
    return df.withColumn(name, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(EPS)))


def moving_mean(value: Column, order: Window, width: int) -> Column:
    """Zero beyond the ends: a sum over the window divided by its full width."""
    half = width // 2
    return F.sum(value).over(order.rowsBetween(-half, half)) / width


def smooth_velocity(notes: DataFrame, width: int = 3, low: int = 30, high: int = 120) -> DataFrame:
    """Truncated moving mean, clipped; files of fewer notes than the window stay."""
    order = Window.partitionBy("file_id").orderBy("start_tick", "note_id")
    n = F.count("*").over(Window.partitionBy("file_id"))
    mean = F.greatest(F.lit(low), F.least(F.lit(high), moving_mean(F.col("velocity"), order, width).cast("int")))
    return notes.withColumn("_n", n).withColumn("smooth", F.when(F.col("_n") < width, F.col("velocity")).otherwise(mean)).drop("_n")


def apply_velocity(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Velocities of (file_id, start_tick, pitch, channel); the last writer (note_id) wins, and misses keep their own."""
    keys = ["file_id", "start_tick", "pitch", "channel"]
    last = new.groupBy(*keys).agg(F.max_by("smooth", "note_id").alias("_new"))
    return notes.join(last, keys, "left").withColumn("velocity", F.coalesce("_new", "velocity")).drop("_new")


def attack_slope(frames: DataFrame, value: str = "env", name: str = "slope") -> DataFrame:
    """Rise over two frames, from the first frame where there are fewer; 0 in the last five."""
    order = Window.partitionBy("file_id").orderBy("frame")
    n = F.count("*").over(Window.partitionBy("file_id"))
    first = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("_n", n).withColumn(name, F.when(F.col("frame") < F.col("_n") - 5, F.col(value) - F.coalesce(F.lag(value, 2).over(order), first)).otherwise(0.0)).drop("_n")


def peak_threshold(frames: DataFrame, value: str = "env", name: str = "threshold", k: float = 0.5) -> DataFrame:
    w = Window.partitionBy("file_id")
    return frames.withColumn(name, F.avg(value).over(w) + k * F.stddev_pop(value).over(w))


def onsets(frames: DataFrame, value: str = "env", sr: int = 22_050, hop: int = 512, delta: float = 0.07, backtrack: bool = True) -> DataFrame:
    """Onsets of an onset envelope: file_id, peak (frame), frame, t.

    A peak is the largest of the 30 ms up to it and lies ``delta`` above the mean of 100 ms on either side, on the envelope scaled to 0..1 a
    file; peaks follow one another by more than 30 ms, earlier ones first. Backtracking moves each to the last local minimum at
    or before it (the first frame counts as one), so two peaks may share an onset. frames: file_id, frame from 0 on."""
    back, around = int(0.03 * sr // hop), int(0.1 * sr // hop)
    whole = Window.partitionBy("file_id")
    order = whole.orderBy("frame")
    v, x = F.col(value).cast("double"), F.col("_x")
    low, high = F.min("_v").over(whole), F.max("_v").over(whole)
    rows = frames.select("file_id", "frame", v.alias("_v")).withColumn("_x", F.when(high > low, (F.col("_v") - low) / (high - low)).otherwise(0.0))
    top = (x >= F.max("_x").over(order.rowsBetween(-back, 0))) & (x >= F.avg("_x").over(order.rowsBetween(-around, around)) + delta)
    before, after = F.lag("_v").over(order), F.lead("_v").over(order)
    base = F.when(before.isNull() | ((F.col("_v") <= before) & (F.col("_v") < after)), F.col("frame"))
    rows = rows.withColumns({"_top": top, "_base": base}).withColumn("_base", F.last("_base", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = temporal.spaced(rows.where("_top").select("file_id", F.col("frame").alias("peak"), "_base"), ["file_id"], "peak", back)
    at = F.col("_base" if backtrack else "peak")
    return found.select("file_id", "peak", at.alias("frame"), M.frame_to_time(at, sr, hop).alias("t"))


def following_mean(frames: DataFrame, value: str, name: str, width: int = 10) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy("frame")
    return frames.withColumn(name, F.avg(value).over(order.rowsBetween(0, width - 1)))


def resonance(frames: DataFrame, name: str = "resonance") -> DataFrame:
    """Mean of the z-scores of centroid and rolloff."""
    both = zscore(zscore(frames, "centroid", "_c"), "rolloff", "_r")
    return both.withColumn(name, (F.col("_c") + F.col("_r")) / 2).drop("_c", "_r")


def refine_pedal(events: DataFrame, frames: DataFrame, sr: int = 22_050, hop: int = 512, least: float = -0.5, width: int = 10) -> DataFrame:
    """Downs stay where the mean resonance over the next frames is above ``least``, or the file ends too soon to tell."""
    z = following_mean(frames, "resonance", "_mean", width)
    last = frames.groupBy("file_id").agg(F.max("frame").alias("_last"))
    rows = events.join(last, "file_id").withColumn("frame", M.nearest_frame(F.col("t"), F.col("_last"), sr, hop))
    rows = rows.join(z.select("file_id", "frame", "_mean"), ["file_id", "frame"], "left")
    return rows.where(~F.col("down") | (F.col("frame") >= F.col("_last") + 1 - width) | (F.col("_mean") > least)).select("file_id", "t", "down")


def detect_pedal(notes: DataFrame, overlap: int = 4, rate: int = 20, least: float = 0.5, short: bool = True) -> DataFrame:
    """Pedal downs and ups from polyphony on an even grid. notes: file_id, start_s, end_s."""
    bounds = notes.groupBy("file_id").agg(F.max("end_s").alias("end"))
    grid = temporal.even_grid(bounds, (F.col("end") * rate).cast("int"))
    n = temporal.count_covering(grid, notes, "start_s", "end_s")
    found = temporal.edges(n, F.col("n") >= overlap)
    w = Window.partitionBy("file_id").orderBy("t")
    last = found.withColumn("_last", F.lead("t").over(w).isNull()).where("_last and down").join(bounds, "file_id").select("file_id", F.col("end").alias("t"), F.lit(False).alias("down"))
    found = found.unionByName(last)
    return temporal.drop_short(found, least) if short else found


def snap_offsets(notes: DataFrame, frames: DataFrame, reach: int = 5, share: float = 0.3, tolerance: int = 5) -> DataFrame:
    """First frame around a note's last frame (from ``reach`` before) whose energy is below a share of the energy there;
    refused if it is more than ``tolerance`` frames away. notes: note_id, file_id, frame."""
    here = notes.join(frames.select("file_id", "frame", F.col("rms").alias("_here")), ["file_id", "frame"])
    near = here.select("note_id", "file_id", "_here", F.col("frame").alias("at"), F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach - 1)).alias("frame"))
    near = near.join(frames.select("file_id", "frame", "rms"), ["file_id", "frame"]).where(F.col("rms") < share * F.col("_here"))
    first = near.groupBy("note_id").agg(F.min("frame").alias("to"), F.first("at").alias("at")).where(F.abs(F.col("to") - F.col("at")) <= tolerance)
    return notes.join(first.select("note_id", "to"), "note_id", "left").withColumn("frame_end", F.coalesce("to", "frame")).drop("to")


def adaptive_parameters(stats: DataFrame, onset: float = 0.5, length: float = 127.7) -> DataFrame:
    """stats: file_id, p25, p75, tempo -> snr, thresholds and minimum length."""
    snr = F.col("p75") / (F.col("p25") + F.lit(1e-6))
    rows = stats.withColumn("snr", snr)
    rows = rows.withColumn("onset", F.when(F.col("snr") < 3, F.lit(min(0.6, onset + 0.1))).when(F.col("snr") > 10, F.lit(max(0.4, onset - 0.05))).otherwise(F.lit(onset)))
    rows = rows.withColumn("frame", F.col("onset") - 0.2)
    return rows.withColumn("length", F.when(F.col("tempo") > 140, F.lit(max(80.0, length - 30))).when(F.col("tempo") < 80, F.lit(min(150.0, length + 20))).otherwise(F.lit(length)))


def energy_percentiles(frames: DataFrame, value: str = "rms") -> DataFrame:
    return frames.groupBy("file_id").agg(F.percentile(value, 0.25).alias("p25"), F.percentile(value, 0.75).alias("p75"))
