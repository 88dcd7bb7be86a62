"""Standard MIDI files: binary content to messages, and events to binary content."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.operators import temporal
from cantora.sources import layout

META = {0x03: "track_name", 0x2F: "end_of_track", 0x51: "set_tempo", 0x58: "time_signature", 0x59: "key_signature"}
KINDS = {0x8: "note_off", 0x9: "note_on", 0xA: "polytouch", 0xB: "control_change", 0xC: "program_change", 0xD: "aftertouch", 0xE: "pitchwheel"}
BATCH = 10_000
SCHEMA = "file_id int, tpb int, track int, seq int, delta long, abs_tick long, kind string, channel int, pitch int, velocity int, control int, value int, tempo int, text string"


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        b = data[at]
        value, at = value << 7 | b & 0x7F, at + 1
        if b < 0x80:
            return value, at


def number(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def parse(content: bytes) -> Iterator[dict]:
    """Messages of all tracks, with running status."""
    if content[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, tracks, tpb = struct.unpack(">IHHH", content[4:14])
    at, track = 8 + size, -1
    while at + 8 <= len(content):
        name, size = struct.unpack(">4sI", content[at : at + 8])
        data, at = content[at + 8 : at + 8 + size], at + 8 + size
        if at > len(content):
            raise ValueError("a chunk ends beyond the file")
        if name != b"MTrk":
            continue
        track, i, seq, tick, status = track + 1, 0, 0, 0, 0
        while i < len(data):
            delta, i = _number(data, i)
            tick, seq = tick + delta, seq + 1
            row = {"tpb": tpb, "track": track, "seq": seq, "delta": delta, "abs_tick": tick}
            if data[i] >= 0x80:
                # metas and sysex leave the running status as it is
                running, status, i = status if status < 0xF0 else running, data[i], i + 1
            elif status >= 0xF0:
                status = running
            if status == 0xFF:
                kind, (n, j) = data[i], _number(data, i + 1)
                body, i = data[j : j + n], j + n
                row["kind"] = META.get(kind, f"meta_{kind:02x}")
                if kind == 0x51:
                    row["tempo"] = int.from_bytes(body, "big")
                elif kind == 0x03:
                    row["text"] = body.decode("latin-1")
            elif status in (0xF0, 0xF7):
                n, i = _number(data, i)
                row["kind"], i = "sysex", i + n
            else:
                high, one = status >> 4, data[i]
                two = data[i + 1] if high not in (0xC, 0xD) else None
                i += 1 if two is None else 2
                row |= {"kind": KINDS[high], "channel": status & 15}
                row |= {"pitch": one, "velocity": two} if high in (0x8, 0x9, 0xA) else {"control": one, "value": two} if high == 0xB else {"value": one if two is None else one | two << 7}
            yield row
    if track + 1 < tracks:
        raise ValueError("fewer tracks than the header says")


def messages(files: DataFrame) -> DataFrame:
    """Messages of rows (file_id, content). A file that isn't a whole MIDI file is one row of kind "malformed" that says why in text.

    Files are parsed twice, to know that they are whole and for their rows, of which a batch is held at a time."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    deque(parse(content or b""), 0)
                    rows = parse(content)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows = iter([{"kind": "malformed", "text": f"{type(e).__name__}: {e}"}])
                while part := list(islice(rows, BATCH)):
                    yield pa.RecordBatch.from_pylist([{"file_id": file_id} | row for row in part], schema)

    return files.select("file_id", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the MIDI files of a path, numbered by layout.numbered()."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mid").load(path)
    return messages(files.join(layout.numbered(files), "path"))


def _file(bodies: list[bytes], tpb: int) -> bytes:
    """A file of format 1 from tracks without their ends."""
    end = b"\x00\xff\x2f\x00"
    return b"".join([b"MThd", struct.pack(">IHHH", 6, 1, len(bodies), tpb), *(x for body in bodies for x in (b"MTrk", struct.pack(">I", len(body) + len(end)), body, end))])


def build(tracks: list[list[tuple[int, bytes]]], tpb: int) -> bytes:
    """A file of format 1 from (delta, message) lists."""
    return _file([b"".join(number(delta) + message for delta, message in events) for events in tracks], tpb)


def write(events: DataFrame, tpb: int = 220, tempo: int = 500_000, rebase: bool = False) -> DataFrame:
    """file_id, content of events (file_id, track, seq, delta, pitch, velocity, is_off); rebase starts each track at 0. Of a file only
    its bytes are held."""
    schema = pa.schema([("file_id", pa.int32()), ("content", pa.binary())])

    def fold(state: tuple[int, int | None, list[bytearray]] | None, batch: pa.RecordBatch | None):
        if batch is None:
            return None, pa.RecordBatch.from_pylist([{"file_id": state[0], "content": _file(state[2], tpb)}], schema)
        file_id, last, bodies = state or (batch.column(0)[0].as_py(), None, [])
        for track, delta, pitch, velocity, off in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5, 6)), strict=True):
            if not bodies or track != last:
                bodies.append(bytearray(b"" if bodies else number(0) + meta(0x51, tempo.to_bytes(3, "big"))))
                last, delta = track, 0 if rebase else delta
            bodies[-1] += number(int(delta)) + bytes([0x80 if off else 0x90, int(pitch), 0 if off else int(velocity)])
        return (file_id, last, bodies), None

    rows = events.select("file_id", "track", "seq", "delta", "pitch", "velocity", "is_off").where("track is not null")
    return temporal.folded(rows, ["file_id"], ["track", "seq"], fold, "file_id int, content binary")


def meta(kind: int, body: bytes) -> bytes:
    return b"\xff" + bytes([kind]) + number(len(body)) + body


def write_track(notes: DataFrame, key: str, head: list[bytes], tpb: int = 480, rebase: bool = False) -> DataFrame:
    """key, content: a file of one track for each key, with these metas first. notes: key, pitch, velocity, start_tick, end_tick;
    at equal ticks ons come first, then by pitch; rebase starts at 0."""

    kind = notes.schema[key].dataType.simpleString()
    both = F.array(*(F.struct(F.col(tick).cast("long").alias("tick"), F.lit(off).alias("off"), velocity.cast("int").alias("velocity")) for tick, off, velocity in (("start_tick", 0, F.col("velocity")), ("end_tick", 1, F.lit(0)))))

    def fold(state: tuple[pa.Array, int, bytearray] | None, batch: pa.RecordBatch | None):
        if batch is None:
            return None, pa.RecordBatch.from_arrays([state[0], pa.array([_file([state[2]], tpb)], pa.binary())], [key, "content"])
        ticks = batch.column(2).to_pylist()
        of, at, body = state or (batch.column(0)[:1], ticks[0] if rebase else 0, bytearray(b"".join(number(0) + m for m in head)))
        for pitch, tick, off, velocity in zip(batch.column(1).to_pylist(), ticks, *(batch.column(k).to_pylist() for k in (3, 4)), strict=True):
            body += number(tick - at) + bytes([0x80 if off else 0x90, int(pitch), velocity])
            at = tick
        return (of, at, body), None

    rows = notes.select(key, "pitch", F.explode(both).alias("e")).select(key, "pitch", "e.*")
    return temporal.folded(rows, [key], ["tick", "off", "pitch", "velocity"], fold, f"{key} {kind}, content binary")


def write_chords(voiced: DataFrame, velocity: int = 80, bpm: int = 120, tpb: int = 480) -> DataFrame:
    """file_id, content of voiced chords (file_id, pitch, start_tick, end_tick), in 4/4."""
    head = [meta(0x51, round(60_000_000 / bpm).to_bytes(3, "big")), meta(0x58, bytes([4, 2, 24, 8])), meta(0x03, b"Chord Progression")]
    return write_track(voiced.withColumn("velocity", F.lit(velocity)), "file_id", head, tpb)


def write_phrases(notes: DataFrame, key: str = "phrase", tpb: int = 480, tempo: int = 500_000) -> DataFrame:
    """key, content of each phrase's notes, which start at 0."""
    return write_track(notes, key, [meta(0x03, b"Musical Phrase"), meta(0x51, tempo.to_bytes(3, "big"))], tpb, rebase=True)
