"""Operators against plain loops on small rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators import cleaning, dynamics, hands, harmony, pairing, scoring, signal, temporal
from cantora.sources import layout, smf, wav
from cantora.streaming import notes as stream


def note_rows(seed, n=60):
    rng = random.Random(seed)
    return [(i, rng.randrange(2), rng.randrange(2), 0, rng.choice([40, 45, 60]), rng.randrange(1, 127), s := rng.randrange(400), s + (k := rng.randrange(0, 60)), k) for i in range(n)]


NOTES = "note_id long, file_id int, track int, channel int, pitch int, velocity int, start_tick long, end_tick long, dur_ticks long"


def test_pairing_equals_loops(spark):
    rng = random.Random(3)
    rows = [(f, t, s, 40 + rng.randrange(3), rng.randrange(0, 3) * 20, 10 * s, rng.choice(["note_on", "note_off"]), rng.randrange(4)) for f in range(2) for t in range(2) for s in range(60)]
    df = spark.createDataFrame(rows, "file_id int, track int, seq int, pitch int, velocity int, abs_tick int, kind string, channel int")
    last, every = [], []
    for f in range(2):
        for t in range(2):
            mine = sorted(r for r in rows if r[:2] == (f, t))
            for p in (40, 41, 42):
                opened = None
                for r in (r for r in mine if r[3] == p):
                    on = r[6] == "note_on" and r[4] > 0
                    if on:
                        opened = r
                    elif opened:
                        last.append((f, t, p, opened[4], opened[5], r[5]))
                        opened = None
                opened = None
                for r in (r for r in mine if r[3] == p):
                    on = r[6] == "note_on" and r[4] > 0
                    if opened:
                        every.append((f, t, p, opened[4], opened[5], r[5]))
                    opened = r if on else None
                if opened:
                    every.append((f, t, p, opened[4], opened[5], mine[-1][5]))
    columns = ["file_id", "track", "pitch", "velocity", "start_tick", "end_tick"]
    assert sorted(map(tuple, pairing.pair_last_on_wins(df).select(*columns).collect())) == sorted(last)
    assert sorted(map(tuple, pairing.pair_retrigger(df).select(*columns).collect())) == sorted(every)


def test_legato_and_rapid_equal_loops(spark):
    rows = note_rows(5)
    df = spark.createDataFrame(rows, NOTES)
    merged, joined = [], []
    for f in range(2):
        for p in (40, 45, 60):
            run = None
            for r in sorted((r for r in rows if r[1] == f and r[4] == p), key=lambda r: (r[6], r[0])):
                if run and 0 <= r[6] - run[3] <= 22:
                    run = (*run[:3], r[7], int((run[4] + r[5]) / 2))
                else:
                    merged += [run] if run else []
                    run = (f, p, r[6], r[7], r[5])
            merged += [run] if run else []
        for t in range(2):
            for p in (40, 45, 60):
                mine = sorted((r for r in rows if r[1:3] == (f, t) and r[4] == p), key=lambda r: (r[6], r[0]))
                i = 0
                while i < len(mine):
                    pair = i + 1 < len(mine) and (mine[i + 1][6] - mine[i][7]) * 2.3 < 30
                    joined.append((f, t, p, mine[i][6], mine[i + pair][7], mine[i][5]))
                    i += 1 + pair
    assert sorted(map(tuple, cleaning.merge_legato(df).select("file_id", "pitch", "start_tick", "end_tick", "velocity").collect())) == sorted(merged)
    assert sorted(map(tuple, cleaning.merge_rapid(df).select("file_id", "track", "pitch", "start_tick", "end_tick", "velocity").collect())) == sorted(joined)


def test_nearest_and_groups_equal_loops(spark):
    rng = random.Random(9)
    left, right = [(i, rng.randrange(2), rng.randrange(200)) for i in range(40)], [(rng.randrange(2), rng.randrange(200)) for _ in range(15)]
    found = temporal.nearest(spark.createDataFrame(left, "note_id int, file_id int, t int"), spark.createDataFrame(right, "file_id int, t int"), tolerance=8)
    for r in found.collect():
        best = min((abs(t - r["t"]), t) for f, t in right if f == r["file_id"])
        assert r["nearest"] == (best[1] if best[0] <= 8 else None)
    groups = {(r["file_id"], r["note_id"]): r["group"] for r in temporal.anchor_groups(spark.createDataFrame(left, "note_id int, file_id int, t int"), 10, ["file_id"], "t", "note_id").collect()}
    for f in range(2):
        anchor, gid = None, 0
        for i, _, t in sorted((x for x in left if x[1] == f), key=lambda x: (x[2], x[0])):
            if anchor is None or t - anchor > 10:
                anchor, gid = t, gid + 1
            assert groups[f, i] == gid


def test_empty_tables(spark):
    none = spark.createDataFrame([], NOTES)
    for df in (cleaning.merge_legato(none), cleaning.correct(none), harmony.identify_chords(none), cleaning.detect_key(none), scoring.polyphony(none), hands.median_split(none), pairing.note_events(none)):
        assert df.count() == 0


def test_key_of_a_scale(spark):
    for root in (0, 2, 9):
        tonic = [(i, 0, 0, 0, 60 + root + p, 64, 10 * i, 10 * i + 10, 10) for i, p in enumerate([0, 2, 4, 5, 7, 9, 11, 12, 0, 0, 7, 7, 4, 0])]
        notes = spark.createDataFrame(tonic, NOTES)
        fixed, compat = cleaning.detect_key(notes, fixed=True).first(), cleaning.detect_key(notes).first()
        assert (fixed["root"], fixed["mode"]) == (root, "major") and compat["root"] == (12 - root) % 12


def test_hands_go_apart():
    rows = [(1, 40, 60), (2, 80, 60), (3, 58, 60), (4, 59, 60), (4, 61, 60), (5, 45, 60), (5, 78, 60)]
    assert hands.assign(rows, 60)[:2] == ["left", "right"] and hands.assign(rows, 60)[-2:] == ["left", "right"]


def test_files_come_back(spark):
    events = pairing.note_events(spark.createDataFrame(note_rows(1), NOTES))
    back = smf.messages(smf.write(events)).where("kind in ('note_on', 'note_off')")
    wanted = sorted((r["file_id"], r["track"], r["tick"], r["pitch"]) for r in events.collect())
    assert sorted((r["file_id"], r["track"], r["abs_tick"], r["pitch"]) for r in back.collect()) == wanted
    y = np.sin(np.arange(22_050) / 10).astype(np.float32) * 0.5
    files = spark.createDataFrame([(1, bytearray(wav.encode(y)))], "file_id int, content binary")
    assert np.allclose(wav.from_content(files).first()["y"], y, atol=1e-3)


def test_rendered_note_is_heard(spark):
    notes = spark.createDataFrame([(0, 69, 100, 0.2, 1.4)], "file_id int, pitch int, velocity int, start_s double, end_s double")
    audio = signal.render(notes)
    heard = signal.transcribe(audio).collect()
    assert any(r["pitch"] == 69 and abs(r["start_s"] - 0.2) < 0.1 for r in heard)
    assert abs(signal.tempo(np.tile([1.0] + [0.0] * 21, 20)) - 117.45) < 1


def test_chunks_equal_whole_recordings(spark):
    rng = random.Random(4)
    rows = [(f, rng.randrange(40, 90), rng.randrange(30, 120), s, s + rng.choice([0.0, 0.02, 0.4, 9.0])) for f, n in ((0, 40), (1, 6)) for s in (rng.random() * 25 for _ in range(n))]
    notes = spark.createDataFrame([*rows, (1, 60, 90, 11.0, 13.0)], "file_id int, pitch int, velocity int, start_s double, end_s double")
    whole = {r["file_id"]: np.array(r["y"], np.float32) for r in signal.render(notes).collect()}
    parts = signal.render_chunks(notes).cache()
    assert parts.count() > 4
    for i, y in whole.items():
        mine = parts.where(f"file_id = {i}").orderBy("first").collect()
        assert np.array_equal(np.concatenate([np.array(r["y"], np.float32)[r["lead"] : r["lead"] + r["samples"]] for r in mine]), y)
        found, wanted = signal.frames(parts.where(f"file_id = {i}")).orderBy("frame").collect(), signal.features(y)
        assert [r["frame"] for r in found] == list(range(len(wanted["rms"])))
        assert all(np.allclose([r[k] for r in found], wanted[k]) for k in ("rms", "env", "centroid", "rolloff"))
    heard = sorted(map(tuple, signal.transcribe(parts).collect()))
    wanted = []
    for i, y in whole.items():
        mag = signal.stft(y)
        for pitch in range(21, 109):
            b = int(round(440 * 2 ** ((pitch - 69) / 12) * signal.N_FFT / signal.SR))
            on = (mag[b] >= 0.25 * mag.max()) & (mag[b] >= mag[b - 1]) & (mag[b] >= mag[b + 1])
            edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0])))).tolist()
            wanted += [(i, pitch, a, z) for a, z in zip(edge[::2], edge[1::2], strict=True) if (z - a) * signal.HOP / signal.SR >= 0.1277]
    step = signal.HOP / signal.SR
    assert heard and sorted((i, p, round(a / step), round(z / step)) for i, p, _, a, z in heard) == sorted(wanted)


def test_audio_queries_read_whole_recordings(spark):
    from cantora.plans import catalog

    d = "/root/testdata/sf0.001"
    notes = catalog.seconds_of(catalog.notes_of(spark, d))
    ends = {r["file_id"]: int(r["e"] * signal.SR) + 1 for r in notes.groupBy("file_id").agg(F.max("end_s").alias("e")).collect()}
    assert {r["file_id"]: r["samples"] for r in catalog.QUERIES["synth_render"](spark, d).collect()} == ends
    assert {r["file_id"]: r["frames"] for r in catalog.QUERIES["wav_frames"](spark, d).collect()} == {i: 1 + n // signal.HOP for i, n in ends.items()}
    assert catalog.QUERIES["band_energy"](spark, d).count() == notes.count()


def test_snaps_and_rhythms_of_all_rows(spark):
    from cantora.plans import catalog

    d = "/root/testdata/sf0.001"
    rows = lambda name: set(map(tuple, catalog.QUERIES[name](spark, d).collect()))
    snapped, rhythms = rows("energy_offset_snap_all"), rows("ngram_rhythm_norm_all")
    assert rows("energy_offset_snap") == snapped and len(snapped) == catalog.frames_of(spark, d).count()
    assert rows("ngram_rhythm_norm") == rhythms and {r[2] for r in rhythms} == set(range(8, 21))


def test_pulses(spark):
    rows = [(0, 0.0, True), (0, 0.2, False), (0, 1.0, True), (0, 2.0, False), (0, 3.0, False)]
    kept = temporal.drop_short(spark.createDataFrame(rows, "file_id int, t double, down boolean"), 0.5)
    assert sorted(r["t"] for r in kept.collect()) == [1.0, 2.0, 3.0]


def test_scalars(spark):
    row = spark.range(1).select(M.note_name(F.lit(61)).alias("n"), F.round(M.midi_to_hz(F.lit(81)), 3).alias("hz"), M.chord_root(F.lit("[C+B]")).alias("none"), M.chord_root(F.lit("F#m7")).alias("root")).first()
    assert tuple(row) == ("C#4", 880.0, None, "F#")


def test_frame_rules(spark):
    frames = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([0, 1, 5, 1, 0, 0, 2, 9, 2, 0])], "file_id int, frame long, env double")
    found = hands.peaks(dynamics.peak_threshold(frames), distance=3)
    assert [r["frame"] for r in found.orderBy("frame").collect()] == [2, 7]


def test_streams(spark, tmp_path):
    rows = note_rows(7)
    messages = pairing.note_events(spark.createDataFrame(rows, NOTES)).select("file_id", "track", "pitch", "seq", F.col("tick").alias("abs_tick"), "velocity", F.when(F.col("is_off") == 1, "note_off").otherwise("note_on").alias("kind"))
    path = str(tmp_path / "messages")
    messages.coalesce(1).write.parquet(path)
    batch = pairing.pair_last_on_wins(messages.withColumn("channel", F.lit(0))).select("file_id", "track", "pitch", "velocity", "start_tick", "end_tick")
    live = stream.drain(stream.pair(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)), "paired")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
    at = spark.createDataFrame(rows, NOTES).select("file_id", "pitch", F.timestamp_millis(F.col("start_tick") * 10).alias("at"))
    at.coalesce(1).write.parquet(str(tmp_path / "at"))
    beats = stream.drain(stream.beat_windows(spark.readStream.schema(at.schema).parquet(str(tmp_path / "at"))), "beats", "complete")
    assert sum(r["n"] for r in beats.collect()) == len(rows)


def test_left_hand_pays_for_the_split_itself():
    hand = hands.Hand(False, [60.0], [1])
    assert hand.cost(60, 0, 1, 60, 12, 0.0, 0.0) == 5.0 and hands.Hand(True, [60.0], [1]).cost(60, 127, 1, 60, 12, 0.0, 0.0) == 0.0
    assert hands.Hand(True, [59.0], [1]).cost(59, 127, 1, 60, 12, 0.0, 0.0) == 6.0


def test_sequence_codes_of_wide_steps(spark):
    row = spark.createDataFrame([([-127, -65, 0, 64, 127], [-127, -66, 0, 64, 127])], "a array<int>, b array<int>")
    assert row.select(F.levenshtein(M.sequence_code(F.col("a")), M.sequence_code(F.col("b")))).first()[0] == 1


def test_band_energy_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    mag = rng.random((4, signal.N_FFT // 2 + 1)).astype(np.float32)
    frames = spark.createDataFrame([(0, k, m) for k, m in enumerate(mag.tolist())], "file_id int, frame long, mag array<float>")
    rows = [(i, 0, p, k * signal.HOP / signal.SR + 1e-6) for i, (p, k) in enumerate([(21, 0), (24, 1), (30, 2), (60, 3), (108, 0), (69, 9)])]
    found = {r["note_id"]: r["energy"] for r in signal.band_energy(frames, spark.createDataFrame(rows, "note_id int, file_id int, pitch int, start_s double")).collect()}
    db = np.maximum(20 * np.log10(np.maximum(mag.astype(float), 1e-5) / mag.max()), -80)
    bins = np.arange(mag.shape[1]) * signal.SR / signal.N_FFT
    for (i, _, p, _), k in zip(rows, (0, 1, 2, 3, 0, 9), strict=True):
        b = int(np.argmin(np.abs(bins - 440 * 2 ** ((p - 69) / 12))))
        wanted = db[k, max(0, b - 5) : min(len(bins), b + 5)].mean() if k < 4 else db[-1].mean()
        assert abs(found[i] - wanted) < 1e-3


def test_running_status_after_metas():
    body = b"\x00\x90\x3c\x40" + b"\x05\xff\x01\x02hi" + b"\x05\x3c\x00" + b"\x00\xff\x2f\x00"
    data = b"MThd\x00\x00\x00\x06\x00\x00\x00\x01\x00\xdc" + b"MTrk" + len(body).to_bytes(4, "big") + body
    assert [(r["kind"], r["abs_tick"], r.get("velocity")) for r in smf.parse(data)] == [("note_on", 0, 64), ("meta_01", 5, None), ("note_on", 10, 0), ("end_of_track", 10, None)]


def test_files_are_exported(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.c/My Song.v2.mp3", bytearray(b"xy")), ("noext", bytearray(b""))], "path string, content binary")
    files = rows.select(layout.output_path("phrases", layout.stem(F.col("path")), f"file://{tmp_path}").alias("path"), "content")
    assert sorted(tuple(r) for r in layout.export(files).collect()) == [(f"file://{tmp_path}/phrases/My Song.v2.mid", 2), (f"file://{tmp_path}/phrases/noext.mid", 0)]
    assert (tmp_path / "phrases" / "My Song.v2.mid").read_bytes() == b"xy"


def test_separation_falls_back(spark):
    audio = spark.range(1)
    assert signal.separate(audio, lambda a: a.where("false"), ("no_such_module",)).count() == 1
    assert signal.separate(audio, lambda a: a.where("false"), ("numpy",)).count() == 0 and not signal.available("no_such_module")
