"""Pitch, tempo and chord functions as column expressions, and the fixed tables they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS_PER_BEAT, TEMPO = 220, 500_000
LOW, HIGH = 21, 108

# Note names, chord qualities with their symbols and intervals, scales, key profiles.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
QUALITIES = [
    ("major", "", [0, 4, 7]),
    ("minor", "m", [0, 3, 7]),
    ("diminished", "dim", [0, 3, 6]),
    ("augmented", "aug", [0, 4, 8]),
    ("dominant7", "7", [0, 4, 7, 10]),
    ("major7", "maj7", [0, 4, 7, 11]),
    ("minor7", "m7", [0, 3, 7, 10]),
    ("minorMaj7", "mM7", [0, 3, 7, 11]),
    ("diminished7", "dim7", [0, 3, 6, 9]),
    ("halfDiminished7", "m7b5", [0, 3, 6, 10]),
    ("dominant9", "9", [0, 4, 7, 10, 14]),
    ("major9", "maj9", [0, 4, 7, 11, 14]),
    ("sus2", "sus2", [0, 2, 7]),
    ("sus4", "sus4", [0, 5, 7]),
]
SCALES = {"major": [0, 2, 4, 5, 7, 9, 11], "minor": [0, 2, 3, 5, 7, 8, 10]}
PROFILES = {
    "major": [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
    "minor": [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17],
}


def ms_per_tick(tempo: float = TEMPO, tpb: int = TICKS_PER_BEAT) -> float:
    return tempo / 1000 / tpb


def tick_to_second(tick: Column, tempo: Column, tpb: int = TICKS_PER_BEAT) -> Column:
    return (tick * tempo).cast("double") / F.lit(tpb * 1e6)


def second_to_tick(second: Column, tpb: int = TICKS_PER_BEAT, tempo: int = TEMPO) -> Column:
    return F.rint(second * F.lit(1e6) * tpb / tempo).cast("long")


def tempo_to_bpm(tempo: Column) -> Column:
    return F.rint(F.lit(60_000_000.0) / tempo).cast("int")


def bpm_to_tempo(bpm: Column) -> Column:
    return F.rint(F.lit(60_000_000.0) / bpm).cast("int")


def pitch_class(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12)).cast("int")


def octave(pitch: Column) -> Column:
    return (F.floor(pitch / 12) - 1).cast("int")


def note_name(pitch: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), pitch_class(pitch) + 1), octave(pitch).cast("string"))


def midi_to_hz(pitch: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (pitch - 69) / F.lit(12.0))


def frame_to_time(frame: Column, sr: int = 22_050, hop: int = 512) -> Column:
    return frame * F.lit(hop) / F.lit(float(sr))


def time_to_frame(t: Column, sr: int = 22_050, hop: int = 512) -> Column:
    return F.floor(t * sr / hop).cast("int")


def nearest_frame(t: Column, last: Column, sr: int = 22_050, hop: int = 512) -> Column:
    """Half-way times go to the lower frame."""
    return F.least(F.greatest(F.ceil(t * sr / hop - 0.5), F.lit(0)), last).cast("int")


def amplitude_db(amplitude: Column, top: Column, floor_db: float = 80.0) -> Column:
    return F.greatest(20 * F.log10(F.greatest(F.lit(1e-5), amplitude) / F.greatest(F.lit(1e-5), top)), F.lit(-floor_db))


def quantise(start: Column, dur: Column, tpb: int = TICKS_PER_BEAT, resolution: int = 16, strength: float = 0.5) -> tuple[Column, Column]:
    """Start and end moved part of the way to the grid, half-even rounding, truncated; the duration stays."""
    grid = F.lit(tpb / (resolution / 4))
    start = start.cast("double")
    moved = start + strength * (F.rint(start / grid) * grid - start)
    begin = moved.cast("long")
    return begin, (begin + dur).cast("long")


def measure(tick: Column, tpb: int = TICKS_PER_BEAT) -> Column:
    return (F.floor(tick / tpb / 4) + 1).cast("int")


def grid_floor(tick: Column, grid: int) -> Column:
    return F.floor(tick / grid).cast("long") * grid


def chord_root(name: Column) -> Column:
    """Two characters if there is a sharp anywhere, else one; null for names in brackets."""
    root = F.when(F.instr(name, "#") > 0, F.substring(name, 1, 2)).otherwise(F.substring(name, 1, 1))
    return F.when(root.isin(NOTE_NAMES), root)


def velocity_blend(energy: Column, attack: Column, low: int = 30, high: int = 120) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), (low + (0.7 * energy + 0.3 * attack) * (high - low)).cast("int")))


def rating(score: Column) -> Column:
    return F.when(score >= 0.9, "Excellent").when(score >= 0.75, "Good").when(score >= 0.6, "Fair").otherwise("Poor")


def overall_score(f1: Column, pitch: Column, chroma: Column, polyphony: Column, rhythm: Column) -> Column:
    return 0.30 * f1 + 0.25 * pitch + 0.20 * chroma + 0.15 * polyphony + 0.10 * rhythm


def sequence_code(values: Column, base: int = 128) -> Column:
    """Integers from -127 to 127 as characters, so that levenshtein compares sequences."""
    return F.array_join(F.transform(values, lambda v: F.chr(v + base)), "")


def scale_mask(mode: str, root: int) -> int:
    return sum(1 << ((p + root) % 12) for p in SCALES[mode])


def chord_templates(spark: SparkSession) -> DataFrame:
    """168 rows: root, q_ord, name, mask."""
    rows = [(r, q, NOTE_NAMES[r] + symbol, sum({1 << ((r + i) % 12) for i in steps})) for q, (_, symbol, steps) in enumerate(QUALITIES) for r in range(12)]
    return spark.createDataFrame(rows, "root int, q_ord int, name string, mask int")


def key_profiles(spark: SparkSession, fixed: bool = False) -> DataFrame:
    """24 rows: root, mode, m_ord, profile, scale_mask. By default profiles are turned left, which names the inverse root."""
    rows = [(r, mode, k, [PROFILES[mode][(pc - r if fixed else pc + r) % 12] for pc in range(12)], scale_mask(mode, r)) for r in range(12) for k, mode in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "root int, mode string, m_ord int, profile array<double>, scale_mask int")
