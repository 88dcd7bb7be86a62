"""Left and right hands. Which hand takes a note depends on what the hands took before, so each file is one fold in order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantora.operators import temporal

RECENT, KEPT, DECAY = 5, 20, 0.9


def median_split(notes: DataFrame, mode: str = "median", split: int = 60) -> DataFrame:
    """The median pitch, truncated, between 48 and 72; or a fixed one."""
    at = F.greatest(F.lit(48), F.least(F.lit(72), F.percentile("pitch", 0.5).cast("int"))) if mode == "median" else F.lit(split)
    return notes.groupBy("file_id").agg(at.alias("split"))


@dataclass
class Hand:
    """What a hand played last: pitches, and the group number of each, from which the weight follows."""

    right: bool
    pitches: list[float] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)

    def add(self, pitch: float, group: int) -> None:
        self.pitches.append(pitch)
        self.groups.append(group)

    def cost(self, pitch: float, velocity: float, group: int, split: int, span: int, w_velocity: float, w_continuity: float) -> float:
        away = abs(pitch - split)
        if not self.pitches:
            return away
        recent = self.pitches[-RECENT:]
        weights = [DECAY ** (group - g) for g in self.groups[-RECENT:]]
        jumps = [abs(pitch - p) for p in recent]
        steps = [j if j <= 2 else 2 * j if j <= 7 else 3 * j for j in jumps]
        flow = sum(w * s for w, s in zip(weights, steps, strict=True)) / sum(weights)
        wide = 50.0 if max(*recent, pitch) - min(*recent, pitch) > span else 0.0
        loud = 10 * (1 - velocity / 127) if self.right else 10 * velocity / 127
        across = 5.0 if (pitch < split) == self.right else 0.0
        return w_continuity * flow + wide + w_velocity * loud + (1 - w_continuity - w_velocity) * (away + across)


class Fold:
    """Both hands, and which takes each note. Groups must come whole and in order; only the last KEPT notes of a hand are held."""

    def __init__(self, split: int, hysteresis: int = 5, span: int = 12, w_velocity: float = 0.3, w_continuity: float = 0.7):
        self.split, self.hysteresis, self.span, self.weights = split, hysteresis, span, (w_velocity, w_continuity)
        self.left, self.right = Hand(False), Hand(True)

    def _pick(self, pitch: float, velocity: float, group: int) -> str:
        if pitch < self.split - self.hysteresis:
            return "left"
        if pitch > self.split + self.hysteresis:
            return "right"
        costs = [h.cost(pitch, velocity, group, self.split, self.span, *self.weights) for h in (self.left, self.right)]
        return "left" if costs[0] < costs[1] else "right"

    def take(self, group: int, pitches: list[int], velocities: list[int]) -> list[str]:
        if len(pitches) > 1 and max(pitches) - min(pitches) > self.span:
            hands = ["left" if p < self.split else "right" for p in pitches]
        else:
            hands = [self._pick(sum(pitches) / len(pitches), sum(velocities) / len(velocities), group)] * len(pitches)
        for pitch, hand in zip(pitches, hands, strict=True):
            (self.left if hand == "left" else self.right).add(pitch, group)
        for h in (self.left, self.right):
            del h.pitches[:-KEPT], h.groups[:-KEPT]
        return hands


def assign(rows: list[tuple[int, int, int]], split: int, **options) -> list[str]:
    """Hands of (group, pitch, velocity) in order, notes of a group together."""
    fold = Fold(split, **options)
    return [hand for group, notes in groupby(rows, key=lambda r: r[0]) for hand in fold.take(group, *map(list, list(zip(*notes, strict=True))[1:]))]


def separate(notes: DataFrame, groups: DataFrame, splits: DataFrame, **options) -> DataFrame:
    """notes with hand and track (right 0, left 1). groups: file_id, note_id, group, as anchor_groups gives them.

    A recording is a fold over its sorted notes, a batch at a time: what is carried on are the hands and the notes of the last group."""
    joined = notes.select("file_id", "note_id", "pitch", "velocity", "start_tick").join(groups.select("file_id", "note_id", "group"), ["file_id", "note_id"]).join(splits, "file_id")
    joined = joined.select("file_id", F.col("note_id").cast("long").alias("note_id"), "pitch", "velocity", "start_tick", "group", "split")

    def step(state: tuple[Fold, list] | None, batch: pa.RecordBatch | None):
        fold, held = state or (Fold(batch.column(6)[0].as_py(), **options), [])
        rows = held + (list(zip(*(batch.column(k).to_pylist() for k in (5, 2, 3, 1, 0)), strict=True)) if batch is not None else [])
        last, held, ids, files, hands = rows[-1][0], [], [], [], []
        for group, members in groupby(rows, key=lambda r: r[0]):
            found = list(members)
            if batch is not None and group == last:  # it may go on in the next batch
                held = found
                break
            hands += fold.take(group, [r[1] for r in found], [r[2] for r in found])
            ids += [r[3] for r in found]
            files += [r[4] for r in found]
        return (fold, held), pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.int32()), pa.array(hands, pa.string())], ["note_id", "file_id", "hand"])

    found = temporal.folded(joined, ["file_id"], ["group", "start_tick", "note_id"], step, "note_id long, file_id int, hand string")
    return found.withColumn("track", F.when(F.col("hand") == "right", 0).otherwise(1))


def peaks(frames: DataFrame, value: str = "env", threshold: str = "threshold", distance: int = 5) -> DataFrame:
    """Local maxima at or above the threshold, at least so many frames apart, higher ones first, of equal ones the later: file_id, frame,
    value. A plateau is one maximum, in its middle. Maxima are cut where they are far enough apart, and only such runs are walked through."""
    order = Window.partitionBy("file_id").orderBy("frame")
    rows = temporal.islands(frames.select("file_id", "frame", F.col(value).alias("value"), F.col(threshold).alias("least")), ["file_id"], ["frame"], F.col("value") == F.lag("value").over(order), "plateau")
    flat = rows.groupBy("file_id", "plateau").agg(F.min("frame").alias("i"), F.max("frame").alias("j"), F.min("value").alias("value"), F.min_by("least", "frame").alias("least"))
    around = Window.partitionBy("file_id").orderBy("plateau")
    flat = flat.select("*", F.lag("value").over(around).alias("before"), F.lead("value").over(around).alias("after"))
    tops = flat.where("value > before and value > after and value >= least").select("file_id", F.expr("cast((i + j) div 2 as long)").alias("frame"), F.col("value").cast("double").alias("value"))
    runs = temporal.islands(tops, ["file_id"], ["frame"], F.col("frame") - F.lag("frame").over(order) < distance, "run")
    runs = runs.groupBy("file_id", "run").agg(F.collect_list("frame").alias("frames"), F.collect_list("value").alias("values"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, at, values in zip(batch["file_id"], batch["frames"], batch["values"], strict=True):
                taken: set[int] = set()
                for v, t in sorted(zip(values.tolist(), at.tolist(), strict=True), reverse=True):
                    if taken.isdisjoint(range(t - distance + 1, t + distance)):
                        taken.add(t)
                        out.append((file_id, t, v))
            yield pd.DataFrame(out, columns=["file_id", "frame", "value"])

    return runs.select("file_id", "frames", "values").mapInPandas(keep, "file_id int, frame long, value double")
