"""WAV and MIDI files: sample kinds, band-limited resampling, chunks, malformed content, numbers of paths."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantora.operators import signal
from cantora.sources import layout, smf, wav

RNG = np.random.default_rng(4)


def wav_bytes(y, rate, kind, extensible=False):
    """A file of samples (frames x channels) between -1 and 1."""
    y = np.atleast_2d(y.T).T
    bits = {"u1": 8, "i2": 16, "u3": 24, "i4": 32, "f4": 32, "f8": 64}[kind]
    if kind == "u1":
        body = np.round(y * 127 + 128).astype("u1").tobytes()
    elif kind == "u3":
        body = b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.round(y * 8388607).astype(int).reshape(-1))
    else:
        body = (y if kind[0] == "f" else np.round(y * (2 ** (bits - 1) - 1))).astype(f"<{kind}").tobytes()
    code, channels = 3 if kind[0] == "f" else 1, y.shape[1]
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 3, code) + bytes(14)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("kind", ["u1", "i2", "u3", "i4", "f4", "f8"])
@pytest.mark.parametrize("extensible", [False, True])
def test_kinds_of_samples(kind, extensible):
    y = RNG.uniform(-0.9, 0.9, (500, 2))
    got = wav.decode(wav_bytes(y, 22_050, kind, extensible))
    assert np.allclose(got, y.mean(axis=1), atol={"u1": 0.01, "i2": 1e-4}.get(kind, 1e-6))
    assert len(wav.decode(wav_bytes(y, 22_050, kind), seconds=0.01)) == 220


def tone(rate, hz, seconds=1.0):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate", [44_100, 48_000, 32_000, 96_000])
def test_resampling_is_band_limited(rate):
    if rate > 32_000:  # what the lower rate can't hold must not come back as another tone
        assert np.abs(wav.decode(wav_bytes(tone(rate, 15_000), rate, "f4"))[500:-500]).max() < 1e-3
    got = wav.decode(wav_bytes(tone(rate, 5_000), rate, "f4"))
    assert len(got) == 22_050
    wanted = tone(22_050, 5_000)
    assert np.abs(got - wanted)[500:-500].max() < 2e-3
    up = wav.decode(wav_bytes(tone(8_000, 1_000), 8_000, "f4"))
    assert np.abs(up - tone(22_050, 1_000))[500:-500].max() < 2e-3


def test_parts_are_the_whole():
    content = wav_bytes(RNG.uniform(-1, 1, 30_000), 44_100, "i2")
    file = wav.header(content)
    whole = wav.resampled(file, 22_050, 0, 15_000)
    for first, last in ((0, 1), (0, 999), (999, 7_000), (7_000, 15_000), (14_999, 15_000), (50, 50)):
        assert np.allclose(wav.resampled(file, 22_050, first, last), whole[first:last], atol=1e-12)


def test_chunks_of_files(spark, tmp_path):
    long, short = RNG.uniform(-0.5, 0.5, 700_000), RNG.uniform(-0.5, 0.5, 900)
    for name, content in (("a/one.wav", wav_bytes(long, 44_100, "i2")), ("b/one.wav", wav_bytes(short, 22_050, "f4")), ("b/broken.wav", b"RIFF1234WAVEfmt "), ("b/empty.wav", b""), ("b/other.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    path = f"{tmp_path}/*"
    whole = wav.read(spark, path)
    assert sorted((r["file_id"], r["y"] is None) for r in whole.collect()) and whole.where("y is null").count() == 1  # Spark leaves out empty files
    order = ["file_id", "first"]
    one = wav.read(spark, path, chunked=True).orderBy(*order).collect()
    two = signal.chunks(whole.where("y is not null")).orderBy(*order).collect()
    assert len(one) == len(two) == 3 and {r["length"] for r in one} == {350_000, 900}
    for a, b in zip(one, two, strict=True):
        assert a[:7] == b[:7] and np.allclose(a["y"], b["y"], atol=1e-6)
    assert {r["length"] for r in wav.read(spark, path, chunked=True, seconds=0.5).collect()} == {11_025, 900}


def test_numbers_of_paths(spark):
    paths = [f"s3/{k % 7}/song {k}.mid" for k in range(300)]
    files = spark.createDataFrame([(p,) for p in [*paths, *paths[:20]]], "path string")
    one = {r["path"]: r["file_id"] for r in layout.numbered(files, buckets=16).collect()}
    assert sorted(one.values()) == list(range(300)) and one == {r["path"]: r["file_id"] for r in layout.numbered(files.repartition(5), buckets=16).collect()}
    assert layout.numbered(files.where("false")).count() == 0


def test_malformed_midi_costs_a_row(spark):
    good = smf.build([[(0, b"\x90\x3c\x40"), (10, b"\x80\x3c\x00")]], 220)
    bad = [b"", b"junk", b"MThd", good[:-3], good[:20], good[:14] + b"MTrk" + struct.pack(">I", 2) + b"\x00\x90", b"MThd" + struct.pack(">IHHH", 6, 1, 1, 220) + b"MTrk" + struct.pack(">I", 3) + b"\x00\xf4\x00"]
    rows = [(i, bytearray(x)) for i, x in enumerate([good, *bad])] + [(99, None)]
    got = smf.messages(spark.createDataFrame(rows, "file_id int, content binary"))
    by = {r["file_id"]: (r["n"], r["bad"]) for r in got.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "malformed").alias("bad")).collect()}
    assert by == {0: (3, 0)} | {i + 1: (1, 1) for i in range(len(bad))} | {99: (1, 1)}
    assert all(r["text"] for r in got.where("kind = 'malformed'").collect())


class Taken:
    """A table of files that gives back what is run over it."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_long_midi_files_are_read_in_parts():
    events = [(k % 300, bytes([0x90, k % 128, 1 + k % 127])) for k in range(2 * smf.BATCH + 7)]
    files = pa.RecordBatch.from_pylist([{"file_id": 3, "content": smf.build([events, events[:5]], 220)}, {"file_id": 4, "content": smf.build([events], 220)[:-9]}])
    parts = list(smf.messages(Taken())(iter([files])))
    rows = [r for part in parts for r in part.to_pylist()]
    assert max(part.num_rows for part in parts) == smf.BATCH
    assert [(r["delta"], r["pitch"], r["velocity"]) for r in rows if r["track"] == 0 and r["kind"] == "note_on"] == [(d, m[1], m[2]) for d, m in events]
    assert len(rows) == len(events) + 5 + 2 + 1 and [(r["file_id"], r["kind"]) for r in rows][-1] == (4, "malformed")


@pytest.mark.parametrize("batch", [3, 10_000])
def test_midi_files_are_written_in_parts(spark, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    events = [(f, track, k, 7 * k % 400, 40 + k, 1 + 9 * k % 127, k % 2) for f in (0, 1) for track in (0, 2) for k in range(11 + f)]
    notes = [(f"p{f}", 40 + 7 * k % 20, 50 + k, 100 + 30 * k, 160 + 30 * k) for f in (0, 1) for k in range(8 + f)]
    try:
        spark.conf.set(name, batch)
        table = spark.createDataFrame(events, "file_id int, track int, seq long, delta long, pitch int, velocity int, is_off int").repartition(3)
        files = {rebase: {r["file_id"]: bytes(r["content"]) for r in smf.write(table, rebase=rebase).collect()} for rebase in (False, True)}
        tracks = {r["phrase"]: bytes(r["content"]) for r in smf.write_phrases(spark.createDataFrame(notes, "phrase string, pitch int, velocity int, start_tick long, end_tick long").repartition(3)).collect()}
    finally:
        spark.conf.set(name, before)
    for rebase in files:
        for f in (0, 1):
            message = lambda r: (r[3] if r[2] or not rebase else 0, bytes([0x80 if r[6] else 0x90, r[4], 0 if r[6] else r[5]]))
            of = [[message(r) for r in events if r[:2] == (f, track)] for track in (0, 2)]
            assert files[rebase][f] == smf.build([[(0, smf.meta(0x51, (500_000).to_bytes(3, "big"))), *of[0]], of[1]], 220)
    for f in (0, 1):
        at, wanted = 100, [(0, smf.meta(0x03, b"Musical Phrase")), (0, smf.meta(0x51, (500_000).to_bytes(3, "big")))]
        for tick, off, p, v in sorted(e for key, p, v, s, t in notes if key == f"p{f}" for e in ((s, 0, p, v), (t, 1, p, 0))):
            wanted.append((tick - at, bytes([0x80 if off else 0x90, p, v])))
            at = tick
        assert tracks[f"p{f}"] == smf.build([wanted], 480)
