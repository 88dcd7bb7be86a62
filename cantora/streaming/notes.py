"""Note streams: beat windows with a watermark, pairing and legato with state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators.harmony import pitch_bit

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def beat_windows(notes: DataFrame, late: str = "10 seconds", beat: str = "500 milliseconds") -> DataFrame:
    """file_id, t, mask, n of notes (file_id, at: timestamp, pitch) in tumbling windows of a beat; later rows than ``late`` go."""
    window = F.window("at", beat)
    return notes.withWatermark("at", late).groupBy("file_id", window.alias("w")).agg(F.bit_or(pitch_bit(F.col("pitch"))).alias("mask"), F.count("*").alias("n")).select("file_id", F.col("w.start").alias("t"), "mask", "n")


def pair(messages: DataFrame) -> DataFrame:
    """Notes of a stream of messages (file_id, track, pitch, seq, abs_tick, velocity, kind): an off closes the on before it, kept as
    state of (file_id, track, pitch). Messages of a key come in order of seq, over batches too."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, velocity = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for tick, v, kind in zip(rows["abs_tick"], rows["velocity"], rows["kind"], strict=True):
            if kind == "note_on" and v > 0:
                start, velocity = int(tick), int(v)
            elif start is not None:
                out.append((*key, velocity, start, int(tick)))
                start = velocity = None
        if start is None:
            if state.exists:
                state.remove()
        else:
            state.update((start, velocity))
        yield pd.DataFrame(out, columns=["file_id", "track", "pitch", "velocity", "start_tick", "end_tick"])

    return messages.groupBy("file_id", "track", "pitch").applyInPandasWithState(run, "file_id int, track int, pitch int, velocity int, start_tick long, end_tick long", "start_tick long, velocity int", "append", "NoTimeout")


def merge_legato(notes: DataFrame, late: str = "10 seconds", within_ms: float = 50, ms_per_tick: float | None = None) -> DataFrame:
    """The batch operator's rows from a stream of notes (note_id, file_id, track, channel, pitch, velocity, start_tick, end_tick) in any order:
    notes of a pitch that follow one another within the gap become one, an overlap breaks the chain.

    A note waits as state of (file_id, pitch) until the watermark, ``late`` behind the latest start, has passed its start, so that all
    notes before it are there; the open note of a chain is put out when the watermark has passed the gap behind its end. State is
    so bounded by the notes of ``late``. Notes that come later than that go, as of any stream with a watermark."""
    per = ms_per_tick or M.ms_per_tick()
    within = int(within_ms / per + 1e-9)
    # a millisecond later than played, as a stream's first watermark is 0 and rows at it are late
    at = F.timestamp_millis(F.floor(F.col("start_tick") * F.lit(per)).cast("long") + 1)
    rows = notes.select("file_id", "pitch", "note_id", "track", "channel", "velocity", "start_tick", "end_tick", at.alias("at")).withWatermark("at", late)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, held = json.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            for batch in batches:
                waiting += [list(map(int, r)) for r in zip(*(batch[c] for c in ("start_tick", "note_id", "track", "channel", "velocity", "end_tick")), strict=True)]
        now, out = state.getCurrentWatermarkMs(), []
        waiting.sort()
        while waiting and math.floor(waiting[0][0] * per) + 1 <= now:
            start, note_id, track, channel, velocity, end = waiting.pop(0)
            if held and 0 <= start - held[5] <= within:
                held[4], held[5], held[6] = int((held[4] + velocity) / 2), end, held[6] + 1
            else:
                out += [held] if held else []
                held = [start, note_id, track, channel, velocity, end, 1]
        until = math.floor(held[5] * per + within_ms) + 2 if held else 0
        if held and until < now:
            out.append(held)
            held = None
        if waiting or held:
            state.update((json.dumps([waiting, held]),))
            next_ = min([math.floor(waiting[0][0] * per) + 2] * bool(waiting) + [until + 1] * bool(held))
            state.setTimeoutTimestamp(max(next_, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, n, t, c, s, e, v, m) for s, n, t, c, v, e, m in out], columns=["file_id", "pitch", "note_id", "track", "channel", "start_tick", "end_tick", "velocity", "merged"])

    schema = "file_id int, pitch int, note_id long, track int, channel int, start_tick long, end_tick long, velocity int, merged int"
    return rows.groupBy("file_id", "pitch").applyInPandasWithState(run, schema, "held string", "append", "EventTimeTimeout")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a finite stream gives now."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
