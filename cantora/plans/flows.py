"""Whole flows: scoring of a transcription, correction to separated hands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators import cleaning, dynamics, hands, harmony, phrases, scoring, signal, temporal


def quality(notes: DataFrame, tolerance: int = 22) -> DataFrame:
    """Track 1 stands for what was heard, track 0 for what was written; without recordings there is no chroma."""
    heard = notes.where("track = 1").select("file_id", F.col("start_tick").alias("t")).distinct()
    written = notes.where("track = 0").select("note_id", "file_id", F.col("start_tick").alias("t"))
    none = notes.select("file_id").distinct().withColumn("chroma", F.lit(0.0))
    return scoring.overall(scoring.onset_scores(heard, written, tolerance), scoring.pitch_accuracy(notes), none, scoring.polyphony_score(scoring.polyphony(notes)), scoring.rhythm_precision(heard, written.select("file_id", "t").distinct()))


def quality_of_audio(audio: DataFrame, notes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The five measures, the overall score and its rating of notes (note_id, file_id, pitch, velocity, start_s, end_s) against recordings.

    Onsets are found in the recording; chroma is compared frame by frame with the notes' own rendering; polyphony is sampled over the
    recording's length. What is held of a frame is a few numbers, kept so that each recording is transformed once."""
    frames = signal.compare(audio, notes).persist()
    heard = dynamics.onsets(signal.onset_strength(frames)).select("file_id", "t")
    written = notes.select("note_id", "file_id", F.col("start_s").alias("t"))
    chroma = frames.groupBy("file_id").agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("chroma"))
    bounds = frames.groupBy("file_id").agg((F.max("length") / F.lit(float(signal.SR))).alias("end"))
    poly = scoring.polyphony_score(temporal.count_covering(temporal.even_grid(bounds, F.lit(100)), notes, "start_s", "end_s"))
    distinct = written.select("file_id", "t").distinct()
    return scoring.overall(scoring.onset_scores(heard, distinct, tolerance), scoring.pitch_accuracy(notes), chroma, poly, scoring.rhythm_precision(heard, distinct))


def enhance_velocities(audio: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes with velocities from a recording: energy around the pitch and steepness of the attack, each scaled a file, blended,
    smoothed over three notes, and given to the notes of equal start, pitch and channel."""
    found = signal.note_features(audio, notes)
    for value in ("energy", "slope"):
        found = dynamics.minmax(found, value, f"{value}_norm")
    new = notes.drop("velocity").join(found.select("note_id", M.velocity_blend(F.col("energy_norm"), F.col("slope_norm")).alias("velocity")), "note_id")
    return dynamics.apply_velocity(notes, dynamics.smooth_velocity(new))


def refine_timing(audio: DataFrame, notes: DataFrame, onset_s: float = 0.05, offset_s: float = 0.1, least_s: float = 0.03, hop: int = 256) -> DataFrame:
    """Notes with onsets at the nearest onset of the recording, and ends at the first frame near them whose smoothed energy is below a
    third of theirs, each within a tolerance; then at least so long."""
    frames = signal.frames(audio, hop).select("file_id", "frame", "rms", "env").persist()
    # the flux of a frame is the step from the one before, so places count from the second frame on
    flux = frames.where("frame > 0").withColumn("frame", F.col("frame") - 1)
    tops = hands.peaks(dynamics.peak_threshold(flux)).select("file_id", M.frame_to_time(F.col("frame"), signal.SR, hop).alias("t"))
    order = Window.partitionBy("file_id").orderBy("frame")
    smooth = frames.select("file_id", "frame", dynamics.moving_mean(F.col("rms"), order, 5).alias("rms"))
    last = frames.groupBy("file_id").agg(F.max("frame").alias("_last"))
    reach = int(offset_s * signal.SR / hop) // 2
    ends = notes.join(last, "file_id").select("note_id", "file_id", M.nearest_frame(F.col("end_s"), F.col("_last"), signal.SR, hop).alias("frame"))
    ends = dynamics.snap_offsets(ends, smooth, reach=reach, tolerance=reach + 1).where("frame_end <> frame").select("note_id", M.frame_to_time(F.col("frame_end"), signal.SR, hop).alias("_end"))
    rows = temporal.nearest(notes.withColumn("t", F.col("start_s")), tops, tolerance=onset_s, name="_on").join(ends, "note_id", "left")
    start = F.coalesce("_on", "start_s")
    end = F.when(F.abs(F.col("_end") - F.col("end_s")) <= offset_s, F.col("_end")).otherwise(F.col("end_s"))
    rows = rows.withColumns({"start_s": start, "end_s": end}).drop("_on", "_end", "t")
    return rows.withColumn("end_s", F.when(F.col("end_s") - F.col("start_s") < least_s, F.col("start_s") + least_s).otherwise(F.col("end_s")))


def parameters_of_audio(audio: DataFrame, seconds: float | None = 30.0, **defaults) -> DataFrame:
    """file_id, snr, tempo and the thresholds and minimum length that suit a recording, by so many seconds from its start (all, if None)."""
    chunked = signal.chunks(audio)
    if seconds is not None:
        chunked = chunked.where(F.col("first") * F.col("hop") < seconds * F.col("sr"))
    frames = signal.frames(chunked).select("file_id", "frame", "t", "rms", "env")
    frames = (frames if seconds is None else frames.where(F.col("t") < seconds)).persist()
    stats = dynamics.energy_percentiles(frames).join(signal.tempos(signal.onset_strength(frames)), "file_id")
    return dynamics.adaptive_parameters(stats, **defaults).select("file_id", "snr", "tempo", "onset", "frame", "length")


def paired_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two series of vector frames for each of eight files."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = v.select((F.col("vec_id") % 8).cast("int").alias("file_id"), F.floor(F.col("vec_id") / 16).alias("frame"), F.col("embedding").alias("c"), (F.col("vec_id") % 16 < 8).alias("first"))
    return rows.where("first"), rows.where("not first")


def process(notes: DataFrame, top: int = 1) -> dict[str, DataFrame]:
    """Corrected notes with hands, chords, key, and phrases of many recordings; every side branch reads the same corrected notes."""
    corrected = cleaning.correct(notes)
    groups = temporal.anchor_groups(corrected, 48, ["file_id"], "start_tick", "note_id")
    assigned = hands.separate(corrected, groups, hands.median_split(corrected)).select("note_id", "hand")
    return {
        "notes": corrected.join(assigned, "note_id"),
        "chords": harmony.identify_chords(corrected),
        "keys": cleaning.detect_key(corrected),
        "phrases": phrases.best_phrases(corrected, top),
    }
