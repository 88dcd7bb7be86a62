"""Onsets, peaks and flows over recordings against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cantora.operators import dynamics, hands, signal, temporal
from cantora.plans import flows

NOTES = "note_id long, file_id int, track int, channel int, pitch int, velocity int, start_tick long, start_s double, end_s double"


def series(seed):
    rng = random.Random(seed)
    out = {0: [0.0] * 12, 1: [3.0], 2: [1.0, 5.0], 3: [5.0, 5.0, 1.0, 1.0, 5.0, 5.0, 5.0, 0.0, 0.0], 4: [float(i) for i in range(30)]}
    for k in range(5, 14):
        out[k] = [float(rng.choice([0, 1, 2, 3, 9]) if k % 2 else rng.random()) for _ in range(rng.randrange(3, 120))]
    return out


def frame_rows(spark, data):
    return spark.createDataFrame([(k, i, v) for k, x in data.items() for i, v in enumerate(x)], "file_id int, frame long, env double").repartition(3)


def plain_onsets(x, back, around, delta=0.07):
    x = np.array(x)
    top = x.max() - x.min()
    n = (x - x.min()) / top if top > 0 else x * 0
    found, last = [], None
    for i in range(len(n)):
        if n[i] >= n[max(0, i - back) : i + 1].max() and n[i] >= n[max(0, i - around) : i + around + 1].mean() + delta and (last is None or i - last > back):
            found.append(i)
            last = i
    low = [0] + [i for i in range(1, len(x) - 1) if x[i] <= x[i - 1] and x[i] < x[i + 1]]
    return [(i, max(m for m in low if m <= i)) for i in found]


@pytest.mark.parametrize(("sr", "hop"), [(22_050, 512), (22_050, 128)])
def test_onsets(spark, sr, hop):
    data = series(3)
    got = {}
    for r in dynamics.onsets(frame_rows(spark, data), sr=sr, hop=hop).collect():
        got.setdefault(r["file_id"], []).append((r["peak"], r["frame"]))
        assert r["t"] == pytest.approx(r["frame"] * hop / sr)
    assert any(len(x) > 1 for x in got.values())
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, x in data.items() if (w := plain_onsets(x, int(0.03 * sr // hop), int(0.1 * sr // hop)))}


def plain_peaks(v, least, distance):
    tops, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if j + 1 < len(v) and v[i - 1] < v[i] > v[j + 1] and v[i] >= least:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for t in sorted(tops, key=lambda t: (-v[t], -t)):
        if all(abs(t - k) >= distance for k in kept):
            kept.append(t)
    return sorted(kept)


@pytest.mark.parametrize("distance", [1, 3, 8])
def test_peaks(spark, distance):
    data = series(7)
    got = {k: [] for k in data}
    for r in hands.peaks(dynamics.peak_threshold(frame_rows(spark, data)), distance=distance).collect():
        got[r["file_id"]].append(r["frame"])
        assert r["value"] == data[r["file_id"]][r["frame"]]
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_peaks(x, np.mean(x) + 0.5 * np.std(x), distance) for k, x in data.items()}


def test_spaced_rows(spark):
    rows = [(k % 3, t, f"r{t}") for k, t in enumerate(random.Random(2).sample(range(400), 200))]
    got = sorted(tuple(r) for r in temporal.spaced(spark.createDataFrame(rows, "file_id int, t long, name string"), ["file_id"], "t", 4).collect())
    wanted = []
    for f in range(3):
        last = None
        for _, t, name in sorted(r for r in rows if r[0] == f):
            if last is None or t - last > 4:
                wanted.append((f, t, name))
                last = t
    assert got == wanted


@pytest.fixture(scope="module")
def music(spark):
    """Two recordings, one longer than a chunk, and what was written of them: shifted, with notes missing, added and beyond the end."""
    rng = random.Random(5)
    rows = []
    for f, seconds in ((0, 3.0), (1, 14.5)):
        for k in range(int(seconds * 4)):
            start = k * 0.25 + rng.random() * 0.05
            rows.append((100 * f + k, f, 0, k % 2, rng.randrange(40, 90), rng.randrange(30, 120), int(start * 440), start, min(start + 0.1 + rng.random() * 0.4, seconds)))
    played = spark.createDataFrame(rows, NOTES)
    written = [(*r[:4], r[4] + (r[0] % 5 == 0), r[5], r[6], r[7] + 0.02, r[8] + 0.03) for r in rows if r[0] % 7] + [(900, 0, 0, 0, 60, 99, 4400, 10.0, 11.0), (901, 1, 0, 0, 60, 99, 0, 14.3, 20.0)]
    audio = {r["file_id"]: np.array(r["y"], np.float64) for r in signal.render(played).collect()}
    return signal.render(played), audio, spark.createDataFrame(written, NOTES), written


def rendered(written, f, length):
    """The notes' own sound, note by note over the whole recording."""
    out = np.zeros(length)
    for _, file_id, _, _, pitch, velocity, _, start, end in written:
        i, j = int(start * 22_050), min(int(end * 22_050), length)
        if file_id != f or j <= i:
            continue
        n = j - i
        env, up, down = np.ones(n), min(220, n // 4), min(1102, n // 4)
        if up:
            env[:up] = np.linspace(0, 1, up)
        if down:
            env[-down:] = np.linspace(1, 0, down)
        out[i:j] += velocity / 127 * 0.1 * np.sin(2 * np.pi * 440 * 2 ** ((pitch - 69) / 12) * np.arange(n) / 22_050) * env
    return out / np.abs(out).max()


@pytest.mark.parametrize("longest", [2.0, 0.02, 0.001])
def test_many_notes_cost_their_bends(monkeypatch, longest):
    """Notes that lie over one another are added a pitch at a time, and give what they give one by one."""
    rng = random.Random(9)
    waves, one = [], signal._wave
    monkeypatch.setattr(signal, "_wave", lambda turn, i, j, *note: waves.append(j - i) or one(turn, i, j, *note))
    rows = [(k, 0, 0, 0, rng.choice([45, 60, 77]), rng.randrange(1, 128), 0, start := 0.5 * (k % 2) + rng.random() * max(longest, 0.02) / 4, start + rng.random() * longest) for k in range(3_000)]
    length = 40_000
    notes = pd.DataFrame([(r[4], r[5], r[7], r[8]) for r in rows], columns=["pitch", "velocity", "start_s", "end_s"])
    y, wanted = signal.synthesise(notes, length), rendered(rows, 0, length)
    assert np.abs(y - wanted).max() < 1e-9 and ((y == 0) == (wanted == 0)).all()
    assert longest < 1 or not waves
    part = signal._mix(notes, length, 9_000, 31_000, 22_050)
    assert np.abs(part / np.abs(signal._mix(notes, length, 0, length, 22_050)).max() - wanted[9_000:31_000]).max() < 1e-9


def whole_chroma(y):
    count = 1 + len(y) // 512
    return signal.pitch_classes(signal.constant_q(np.pad(y, (signal.REACH, signal.REACH + 512)), count))


def test_constant_q_is_the_direct_transform():
    """Each bin's sum over its own window at the full rate, without octaves."""
    rng = np.random.default_rng(1)
    y = np.pad(rng.normal(0, 0.1, 60_000) + np.sin(2 * np.pi * 261.63 * np.arange(60_000) / 22_050), (signal.REACH, signal.REACH))
    got = signal.constant_q(y, 100)
    assert got.shape == (252, 100)
    for k in (0, 7, 40, 100, 108, 150, 215, 251):
        freq = signal.LOWEST * 2 ** (k / 36)
        width = 22_050 / freq / (2 ** (1 / 36) - 1)
        n = np.arange(-int(width / 2), int(width / 2) + 1)
        window = 0.5 + 0.5 * np.cos(2 * np.pi * n / width)
        for t in (0, 31, 60, 99):
            at = signal.REACH + 512 * t
            wanted = abs((y[at + n] * window * np.exp(-2j * np.pi * freq * n / 22_050)).sum()) / window.sum()
            assert got[k, t] == pytest.approx(wanted, rel=0.02, abs=2e-4)
    assert (signal.pitch_classes(got)[:, 20:90].argmax(axis=0) == 0).all()  # a C
    with pytest.raises(ValueError, match="halves the hop"):
        signal.constant_q(y, 3, hop=96)


def test_constant_q_of_parts_is_that_of_the_whole():
    rng = np.random.default_rng(2)
    y = np.pad(rng.normal(0, 1, 400_000), (signal.REACH, signal.REACH))
    whole = signal.constant_q(y, 700)
    part = signal.constant_q(y[512 * 300 : 512 * 420 + 2 * signal.REACH], 120)
    assert np.allclose(part, whole[:, 300:420], rtol=1e-6, atol=1e-9)


def later(env):
    return np.concatenate(([0.0, 0.0], env))[: len(env)]


def test_quality_of_audio(music):
    recording, audio, notes, written = music
    got = {r["file_id"]: r for r in flows.quality_of_audio(recording, notes).collect()}
    for f, y in audio.items():
        a, near = signal.features(y), []
        one, two = (whole_chroma(x) for x in (y, rendered(written, f, len(y))))
        for k in range(one.shape[1]):
            p, q = one[:, k], two[:, k]
            if p.any() and q.any():
                near.append(max(0, p @ q / np.sqrt((p @ p) * (q @ q))))
        assert got[f]["chroma"] == pytest.approx(np.mean(near), abs=1e-4) and 0.3 < got[f]["chroma"] < 1
        heard = np.array([base * 512 / 22_050 for _, base in plain_onsets(later(a["env"]), 1, 4)])
        mine = sorted({r[7] for r in written if r[1] == f})
        taken = set()
        for t in mine:
            k = int(np.argmin(np.abs(heard - t)))
            if abs(heard[k] - t) <= 0.05:
                taken.add(k)
        p, r = len(taken) / len(mine), len(taken) / len(heard)
        assert got[f]["f1"] == pytest.approx(2 * p * r / (p + r)) and got[f]["f1"] > 0.3
        mean = np.mean([sum(r[7] <= t <= r[8] for r in written if r[1] == f) for t in np.linspace(0, len(y) / 22_050, 100)])
        assert got[f]["polyphony"] == (0.9 if 2 <= mean <= 6 else 0.7 if 1 <= mean <= 8 else 0.5)
        assert got[f]["pitch"] == 0.85 and 0 < got[f]["rhythm"] <= 1 and got[f]["rating"]


def test_velocities_of_audio(music):
    recording, audio, notes, written = music
    got = {r["note_id"]: r["velocity"] for r in flows.enhance_velocities(recording, notes).collect()}
    for f, y in audio.items():
        mag = signal.stft(y)
        env = later(np.maximum(0, np.diff(mag, axis=1, prepend=mag[:, :1])).sum(axis=0))
        db = np.maximum(20 * np.log10(np.maximum(mag, 1e-5) / mag.max()), -80)
        mine = sorted((r for r in written if r[1] == f), key=lambda r: (r[6], r[0]))
        energy, slope = [], []
        for r in mine:
            at, b = int(r[7] * 22_050 / 512), int(np.argmin(np.abs(np.arange(1025) * 22_050 / 2048 - 440 * 2 ** ((r[4] - 69) / 12))))
            energy.append(db[max(0, b - 5) : b + 5, at].mean() if at < db.shape[1] else db[:, -1].mean())
            slope.append(env[at] - env[max(0, at - 2)] if at < len(env) - 5 else 0.0)
        scale = lambda x: (np.array(x) - min(x)) / (max(x) - min(x) + 1e-8)
        both = 30 + (0.7 * scale(energy) + 0.3 * scale(slope)) * 90
        plain = np.clip(both, 30, 120).astype(int)
        smooth = np.clip(np.convolve(plain, np.ones(3) / 3, mode="same"), 30, 120).astype(int)
        far = [abs(int(v) - got[r[0]]) for v, r in zip(smooth, mine, strict=True)]
        assert max(far) <= 1 and sum(far) <= len(far) // 10 and len(set(smooth)) > 3  # chunks hold 32-bit samples


def test_timing_of_audio(music):
    recording, audio, notes, written = music
    got = {r["note_id"]: (r["start_s"], r["end_s"]) for r in flows.refine_timing(recording, notes).collect()}
    assert len(got) == len(written)
    moved = 0
    for f, y in audio.items():
        mag = signal.stft(y, hop=256)
        flux = np.maximum(0, np.diff(mag, axis=1)).sum(axis=0)
        heard = np.array(plain_peaks(flux, flux.mean() + 0.5 * flux.std(), 5)) * 256 / 22_050
        rms = signal.features(y, hop=256)["rms"]
        smooth = np.convolve(rms, np.ones(5) / 5, mode="same")
        times = np.arange(len(smooth)) * 256 / 22_050
        for r in (r for r in written if r[1] == f):
            near = heard[np.argmin(np.abs(heard - r[7]))]
            start = near if abs(near - r[7]) <= 0.05 else r[7]
            k, end = int(np.argmin(np.abs(times - r[8]))), r[8]
            for i in range(max(0, k - 4), min(len(smooth), k + 4)):
                if smooth[i] < 0.3 * smooth[k]:
                    end = times[i] if abs(times[i] - r[8]) <= 0.1 else end
                    break
            end = start + 0.03 if end - start < 0.03 else end
            moved += (start != r[7]) + (end != r[8])
            assert got[r[0]] == pytest.approx((start, end), abs=1e-6)
    assert moved > 20


def test_note_features_meet_band_energies(spark, music):
    recording, _, notes, _ = music
    old = {r["note_id"]: r["energy"] for r in signal.band_energy(signal.frames(recording, spectra=True), notes).collect()}
    new = {r["note_id"]: r["energy"] for r in signal.note_features(recording, notes).collect()}
    assert new.keys() == old.keys() and all(new[k] == pytest.approx(old[k], abs=1e-3) for k in old)


def plain_tempo(env):
    half = 172
    starts = [0] + [w * half for w in range(1, len(env)) if w * half + half <= len(env) - 1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2 * half) / (2 * half))
    total = np.zeros(2 * half - 1)
    for a in starts:
        x = np.array(env[a : a + 2 * half])
        x = x * hann[: len(x)]
        auto = np.array([x[: len(x) - k] @ x[k:] if k < len(x) else 0.0 for k in range(1, 2 * half)])
        total += auto / auto.max() if auto.max() > 0 else 0
    bpm = 60 * 22_050 / 512 / np.arange(1, 2 * half)
    score = np.log1p(1e6 * np.maximum(total / len(starts), 0)) - 0.5 * (np.log2(bpm) - np.log2(120)) ** 2
    return bpm[np.argmax(np.where(bpm <= 320, score, -np.inf))] if total.max() > 0 else 120.0


def test_tempos(spark):
    rng, data = random.Random(3), {0: [0.0] * 50, 1: [1.0]}
    for k, beat in enumerate((16, 22, 33), 2):
        data[k] = [(1.0 if i % beat == 0 else 0.0) + 0.1 * rng.random() for i in range(1_000 + 100 * k)]
    got = {r["file_id"]: r["tempo"] for r in signal.tempos(frame_rows(spark, data)).collect()}
    assert got == {k: pytest.approx(plain_tempo(x)) for k, x in data.items()}
    assert got[0] == 120 and got[3] == pytest.approx(60 * 22_050 / 512 / 22)


def test_parameters_of_audio(music):
    recording, audio, _, _ = music
    got = {r["file_id"]: r for r in flows.parameters_of_audio(recording).collect()}
    part = {r["file_id"]: r for r in flows.parameters_of_audio(recording, seconds=2.0).collect()}
    for f, y in audio.items():
        a = signal.features(y)
        env = later(a["env"])
        for n, r in ((len(env), got[f]), (int(np.ceil(2.0 * 22_050 / 512)), part[f])):
            low, high = np.percentile(a["rms"][:n], [25, 75])
            assert r["snr"] == pytest.approx(high / (low + 1e-6), rel=1e-4) and r["tempo"] == pytest.approx(plain_tempo(env[:n]))
            assert r["onset"] == pytest.approx(0.6 if r["snr"] < 3 else 0.45 if r["snr"] > 10 else 0.5) and r["frame"] == pytest.approx(r["onset"] - 0.2)
            assert r["length"] == pytest.approx(97.7 if r["tempo"] > 140 else 147.7 if r["tempo"] < 80 else 127.7)


def test_chunks_of_a_recording_are_dealt_out(spark):
    """Few notes are much work: parts put together by their bytes, or dealt by recordings, were one task."""
    rows = [(0, 60 + k % 12, 80, 2.0 * k, 2.0 * k + 1.5) for k in range(60)]
    notes = spark.createDataFrame(rows, "file_id int, pitch int, velocity int, start_s double, end_s double")
    got = signal.render_chunks(notes).select("first", F.spark_partition_id().alias("part")).collect()
    assert sorted(r["first"] for r in got) == [signal.CHUNK * k for k in range(11)] and len({r["part"] for r in got}) > 1
