"""Frame features of recordings in numpy, a chunk of a recording at a time, and rendering of notes.

Audio is rows of whole recordings (file_id, sr, y) or of their chunks of at most CHUNK frames: file_id, sr, hop, first (frame), lead,
samples, length (of the recording), y. A chunk's own samples are y[lead : lead + samples]; y has besides what its frames and the one before its first read.

The recording's onset strength and the chroma of features() are plain spectral approximations, not those of any audio library; compare()
uses the chroma of a constant-Q bank.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SR, HOP, N_FFT, CHUNK = 22_050, 512, 2048, 512
CHUNKS = "file_id int, sr int, hop int, first long, lead int, samples long, length long, y array<float>"


def stft(y: np.ndarray, n_fft: int = N_FFT, hop: int = HOP, padded: bool = False) -> np.ndarray:
    """Magnitudes, bins x frames, of a centred Hann window. A padded y has half a window on both sides already."""
    y = np.asarray(y, np.float64) if padded else np.pad(np.asarray(y, np.float64), n_fft // 2)
    n = 1 + (len(y) - n_fft) // hop
    frames = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop][:n]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.abs(np.fft.rfft(frames * window, axis=1)).T


def flux(mag: np.ndarray) -> np.ndarray:
    """What magnitudes (bins x frames) gain from frame to frame, 0 in the first."""
    return np.maximum(0, np.diff(mag, axis=1, prepend=mag[:, :1])).sum(axis=0)


def features(y: np.ndarray, sr: int = SR, hop: int = HOP, padded: bool = False) -> dict[str, np.ndarray]:
    """rms, env (positive flux), centroid and rolloff of each frame, and chroma (12 x frames, largest 1)."""
    y = np.asarray(y, np.float64) if padded else np.pad(np.asarray(y, np.float64), N_FFT // 2)
    mag = stft(y, hop=hop, padded=True)
    freq = np.fft.rfftfreq(N_FFT, 1 / sr)
    windows = np.lib.stride_tricks.sliding_window_view(y, N_FFT)[::hop][: mag.shape[1]]
    total = mag.sum(axis=0) + 1e-12
    rolled = np.cumsum(mag, axis=0) >= 0.85 * total
    pitch = np.round(12 * np.log2(np.maximum(freq, 1e-6) / 440)).astype(int) + 69
    chroma = np.zeros((12, mag.shape[1]))
    heard = (freq > 27) & (freq < 4200)
    np.add.at(chroma, (pitch % 12)[heard], mag[heard])
    return {"rms": np.sqrt((windows**2).mean(axis=1)), "env": flux(mag), "centroid": (freq[:, None] * mag).sum(axis=0) / total, "rolloff": freq[rolled.argmax(axis=0)], "chroma": chroma / np.maximum(chroma.max(axis=0), 1e-12), "mag": mag}


#: The constant-Q bank: octaves from the lowest frequency (C1), bins of each, and what lies on both sides of the frames that are asked for.
OCTAVES, PER_OCTAVE, LOWEST, REACH = 7, 36, 440 * 2 ** (-45 / 12), 36_864


@lru_cache(4)
def _kernels(sr: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines (samples x bins) of the top octave in Hann windows of Q periods, around the middle."""
    freq = LOWEST * 2 ** (OCTAVES - 1 + np.arange(PER_OCTAVE) / PER_OCTAVE)
    width = sr / freq / (2 ** (1 / PER_OCTAVE) - 1)
    half = 1 << int(np.ceil(np.log2(width.max() / 2)))
    n = np.arange(-half, half)[:, None]
    window = np.where(np.abs(n) < width / 2, 0.5 + 0.5 * np.cos(2 * np.pi * n / width), 0.0)
    window /= window.sum(axis=0)
    return window * np.cos(2 * np.pi * freq * n / sr), window * np.sin(2 * np.pi * freq * n / sr)


@lru_cache(1)
def _half_band() -> np.ndarray:
    n = np.arange(-15, 16)
    taps = 0.5 * np.sinc(0.5 * n) * np.kaiser(31, 9)
    return taps / taps.sum()


def constant_q(y: np.ndarray, count: int, sr: int = SR, hop: int = HOP) -> np.ndarray:
    """Magnitudes (bins x frames) of geometrically spaced bins at ``count`` frames, the first of which is REACH samples from the start of y,
    which goes on as far behind the last. The bank of the top octave serves all, on a signal of half the rate for each octave down; y
    starts at a multiple of 2^6 samples of its recording, so parts of it give what the whole gives."""
    if hop % (1 << OCTAVES - 1):
        raise ValueError("every octave halves the hop")
    (cosines, sines), out, x = _kernels(sr), [], np.asarray(y, np.float64)
    half = len(cosines) // 2
    for octave in range(OCTAVES):
        at = (REACH >> octave) - half + (hop >> octave) * np.arange(count)
        frames = np.lib.stride_tricks.sliding_window_view(x, 2 * half)[at]
        out.append(np.sqrt((frames @ cosines) ** 2 + (frames @ sines) ** 2).T)
        x = np.convolve(x, _half_band(), "same")[::2]
    return np.concatenate(out[::-1])


def pitch_classes(bins: np.ndarray) -> np.ndarray:
    """Chroma (12 x frames, largest 1) of constant-Q bins: each class has the bins nearest to it in all octaves."""
    per = PER_OCTAVE // 12
    folded = np.roll(bins.reshape(OCTAVES, PER_OCTAVE, -1).sum(axis=0), per // 2, axis=0).reshape(12, per, -1).sum(axis=1)
    return folded / np.maximum(folded.max(axis=0), 1e-12)


def tempo(env: np.ndarray, sr: int = SR, hop: int = HOP) -> float:
    """Beats a minute from the autocorrelation of the onset strength, 40 to 240."""
    x = env - env.mean()
    if len(x) < 4 or not x.any():
        return 120.0
    corr = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: len(x)]
    lags = np.arange(1, len(x))
    bpm = 60 * sr / hop / lags
    fit = (bpm >= 40) & (bpm <= 240)
    return float(bpm[fit][np.argmax(corr[1:][fit] * np.exp(-0.5 * (np.log2(bpm[fit] / 120)) ** 2))]) if fit.any() else 120.0


def tempos(frames: DataFrame, value: str = "env", sr: int = SR, hop: int = HOP, usual: float = 120.0, most: float = 320.0) -> DataFrame:
    """file_id, tempo (beats a minute) of onset strengths, from a tempogram: autocorrelations of windows of 8 s that overlap by half, each
    scaled to its largest, averaged a recording; of all lags the one of the largest logarithm, less the square of its octaves
    from the usual tempo by half. Without any rise the usual tempo. Windows are the unit of work, lags of the average."""
    half = int(4 * sr / hop)
    at = F.expr(f"cast(frame div {half} as long)")
    rows = frames.select("file_id", "frame", F.col(value).cast("double").alias("v"), F.explode(F.array(at, at - 1)).alias("window")).where("window >= 0")
    # a window that only the end of a recording reaches is part of the one before
    last = F.max("frame").over(Window.partitionBy("file_id"))
    rows = rows.withColumn("_last", last).where((F.col("window") == 0) | (F.col("window") * half + half <= F.col("_last")))
    rows = rows.groupBy("file_id", "window").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("of")).select("file_id", F.col("of.v").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2 * half) / (2 * half))
        for batch in batches:
            for file_id, v in zip(batch["file_id"], batch["v"], strict=True):
                x = np.asarray(v) * hann[: len(v)]
                auto = np.fft.irfft(np.abs(np.fft.rfft(x, 4 * half)) ** 2)[1 : 2 * half]
                top = np.abs(auto).max()
                yield pd.DataFrame({"file_id": file_id, "lag": np.arange(1, 2 * half), "auto": auto / top if top > 0 else 0.0})

    mean = rows.mapInPandas(run, "file_id int, lag int, auto double").groupBy("file_id", "lag").agg(F.avg("auto").alias("auto"))
    bpm = F.lit(60.0 * sr / hop) / F.col("lag")
    score = F.log1p(1e6 * F.greatest(F.col("auto"), F.lit(0.0))) - 0.5 * F.pow(F.log2(bpm) - F.log2(F.lit(usual)), 2)
    best = F.max_by(bpm, F.struct(F.when(bpm <= most, score).alias("score"), (-F.col("lag")).alias("lag")))
    return mean.groupBy("file_id").agg(F.when(F.max("auto") > 0, best).otherwise(F.lit(usual)).alias("tempo"))


def _mix(notes: pd.DataFrame, length: int, first: int, last: int, sr: int) -> np.ndarray:
    """Samples first to last of a recording of ``length`` samples, 0 outside it, before they are scaled. A pitch whose notes have more
    samples than twice the stretch they lie in is added as a whole."""
    y = np.zeros(last - first)
    begin, stop = (notes["start_s"].to_numpy() * sr).astype(np.int64), np.minimum((notes["end_s"].to_numpy() * sr).astype(np.int64), length)
    reached = np.flatnonzero((stop > begin) & (begin < last) & (stop > first))
    begin, stop, pitch = begin[reached], stop[reached], notes["pitch"].to_numpy()[reached]
    loud, n = notes["velocity"].to_numpy()[reached] / 127 * 0.1, stop - begin
    attack, release = np.minimum(int(0.01 * sr), n // 4), np.minimum(int(0.05 * sr), n // 4)
    low, high = np.maximum(begin, first), np.minimum(stop, last)
    order, dense = np.argsort(pitch, kind="stable"), False
    for own in np.split(order, np.flatnonzero(np.diff(pitch[order])) + 1) if len(order) else ():
        part = y[low[own].min() - first : high[own].max() - first]
        turn = 2 * np.pi * 440 * 2 ** ((pitch[own[0]] - 69) / 12) / sr
        if (high[own] - low[own]).sum() > 2 * len(part):
            dense = True
            _add_all(part, turn, begin[own] - low[own].min(), n[own], loud[own], attack[own], release[own])
        else:
            for k in own:
                y[low[k] - first : high[k] - first] += _wave(turn, low[k] - begin[k], high[k] - begin[k], n[k], loud[k], attack[k], release[k])
    if dense:
        # sums of envelopes are rounded, silence is 0
        count = np.bincount(np.maximum(begin + (attack > 0) - first, 0).clip(max=len(y)), minlength=len(y) + 1) - np.bincount((stop - (release > 1) - first).clip(0, len(y)), minlength=len(y) + 1)
        y[np.cumsum(count)[:-1] == 0] = 0
    return y


def _wave(turn: float, i: int, j: int, n: int, loud: float, attack: int, release: int) -> np.ndarray:
    """Samples i to j of a note of n samples."""
    wave = loud * np.sin(turn * np.arange(i, j))
    if i < attack:
        wave[: attack - i] *= np.linspace(0, 1, attack)[i:j]
    if j > n - release:
        k = max(i, n - release)
        wave[k - i :] *= np.linspace(1, 0, release)[k - (n - release) : j - (n - release)]
    return wave


def _add_all(y: np.ndarray, turn: float, begin: np.ndarray, n: np.ndarray, loud: np.ndarray, attack: np.ndarray, release: np.ndarray) -> None:
    """Adds all notes of a pitch to y, where each begins at its place (below 0 if before y).

    They are shifts of one sine, so their sum is its sine and cosine, each times a sum of envelopes. Envelopes are straight between
    four bends, so their sum is that of the bends, summed twice: a note costs its bends, not its samples."""
    up = np.where(attack > 0, 1, 0), np.where(attack > 0, np.maximum(attack, 2), 1)
    down = np.where(release > 1, n - release + 1, n), np.where(release > 1, n, n + 1)
    rise, fall = loud / (up[1] - up[0]), loud / (down[1] - down[0])
    at, bend = np.concatenate((*up, *down)) + np.tile(begin, 4), np.concatenate((rise, -rise, -fall, fall))
    inside, early = at < len(y), at < 0
    # the angles of 512 samples, turned on by as many at a time
    circle = (np.exp(1j * turn * 512 * np.arange(-(-len(y) // 512)))[:, None] * np.exp(1j * turn * np.arange(512))).reshape(-1)[: len(y)]
    for wave, shift in ((circle.imag, np.cos(turn * begin)), (-circle.real, np.sin(turn * begin))):
        w = bend * np.tile(shift, 4)
        slope = np.cumsum(np.bincount(np.maximum(at, 0)[inside], w[inside], len(y)))
        slope[0] -= (w * at)[early].sum()
        y += wave * np.cumsum(slope)


def synthesise(notes: pd.DataFrame, length: int, sr: int = SR) -> np.ndarray:
    """Sines with a linear attack of 10 ms and release of 50 ms (a quarter of a note at most), then scaled to a peak of 1."""
    y = _mix(notes, length, 0, length, sr)
    top = np.abs(y).max() if length else 0
    return y / top if top > 0 else y


def render(notes: DataFrame, sr: int = SR) -> DataFrame:
    """file_id, sr, y of notes (file_id, pitch, velocity, start_s, end_s)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y = synthesise(group.sort_values(["start_s", "pitch"]), int(group["end_s"].max() * sr) + 1, sr)
        return pd.DataFrame({"file_id": [group["file_id"].iloc[0]], "sr": [sr], "y": [y.astype(np.float32)]})

    return notes.select("file_id", "pitch", "velocity", "start_s", "end_s").groupBy("file_id").applyInPandas(run, "file_id int, sr int, y array<float>")


def bounds(first: int, length: int, hop: int, beyond: int = N_FFT // 2) -> tuple[int, int, int, int]:
    """lead, samples, and the places where y begins and ends, of the chunk at a frame; beyond: what y has on both sides of its frames."""
    count = min(CHUNK, 1 + length // hop - first)
    lead = beyond + (hop if first else 0)
    begin = first * hop - lead
    return lead, max(0, min((first + CHUNK) * hop, length) - first * hop), begin, (first + count - 1) * hop + beyond


def _pieces(notes: DataFrame, sr: int, hop: int, beyond: int) -> DataFrame:
    """Notes with each chunk (of CHUNK frames) whose samples or frames they reach, beyond a recording's end as well."""
    of = lambda sample: F.floor(sample / (CHUNK * hop)).cast("long")
    reach = F.sequence(F.greatest(of(F.floor(F.col("start_s") * sr) - beyond), F.lit(0)), of(F.floor(F.col("end_s") * sr) + hop + beyond))
    return notes.where("end_s > start_s").withColumn("chunk", F.explode(reach))


def render_chunks(notes: DataFrame, sr: int = SR, hop: int = HOP, beyond: int = N_FFT // 2) -> DataFrame:
    """Chunks of what render() gives. The notes of each chunk are mixed twice: for the recording's peak, and to be scaled by it.

    Chunks are dealt out in so many parts: a few notes are much work, so that parts must not be put together by their bytes, and a join by
    recordings would leave all chunks of one in one task."""
    notes = notes.select("file_id", "pitch", "velocity", "start_s", "end_s")
    lengths = notes.groupBy("file_id").agg((F.floor(F.max("end_s") * sr) + 1).cast("long").alias("length"))
    last = F.floor(F.floor(F.col("length") / hop) * hop / (CHUNK * hop)).cast("long")
    rows = _pieces(notes, sr, hop, beyond).join(lengths, "file_id").where(F.col("chunk") <= last)
    rows = rows.select(*notes.columns, "length", "chunk")
    silent = lengths.select("file_id", *[F.lit(0).cast(notes.schema[c].dataType).alias(c) for c in notes.columns[1:]], "length").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.unionByName(silent)
    parts = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def mixed(group: pd.DataFrame) -> tuple[int, int, int, np.ndarray]:
        first, length = int(group["chunk"].iloc[0]) * CHUNK, int(group["length"].iloc[0])
        lead, samples, begin, end = bounds(first, length, hop, beyond)
        return first, lead, samples, _mix(group.sort_values(["start_s", "pitch"]), length, begin, end, sr)

    def loudest(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file_id": [group["file_id"].iloc[0]], "top": [float(np.abs(mixed(group)[3]).max())]})

    def scaled(group: pd.DataFrame) -> pd.DataFrame:
        first, lead, samples, y = mixed(group)
        top = group["top"].iloc[0]
        return pd.DataFrame({"file_id": [group["file_id"].iloc[0]], "sr": sr, "hop": hop, "first": first, "lead": lead, "samples": samples, "length": int(group["length"].iloc[0]), "y": [(y / top if top > 0 else y).astype(np.float32)]})

    dealt = lambda df: df.repartition(parts, "file_id", "chunk").groupBy("file_id", "chunk")
    tops = dealt(rows).applyInPandas(loudest, "file_id int, top double").groupBy("file_id").agg(F.max("top").alias("top"))
    return dealt(rows.join(tops, "file_id")).applyInPandas(scaled, CHUNKS)


def chunks(audio: DataFrame, hop: int = HOP, beyond: int = N_FFT // 2) -> DataFrame:
    """Whole recordings as chunks; chunks as they are."""
    if "first" in audio.columns:
        return audio

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, sr, y in zip(batch["file_id"], batch["sr"], batch["y"], strict=True):
                for first in range(0, 1 + len(y) // hop, CHUNK):
                    lead, samples, begin, end = bounds(first, len(y), hop, beyond)
                    part = np.pad(np.asarray(y[max(begin, 0) : end], np.float32), (max(-begin, 0), max(end - len(y), 0)))
                    yield pd.DataFrame({"file_id": [file_id], "sr": sr, "hop": hop, "first": first, "lead": lead, "samples": samples, "length": len(y), "y": [part]})

    return audio.select("file_id", "sr", "y").mapInPandas(run, CHUNKS)


def frames(audio: DataFrame, hop: int = HOP, spectra: bool = False) -> DataFrame:
    """A row a frame: file_id, frame, t, rms, env, centroid, rolloff, chroma[, mag]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, sr, hop, first, y in zip(batch["file_id"], batch["sr"], batch["hop"], batch["first"], batch["y"], strict=True):
                f = {k: v[..., int(first > 0) :] for k, v in features(y, sr, hop, padded=True).items()}
                n = len(f["rms"])
                frame = first + np.arange(n)
                out = pd.DataFrame({"file_id": np.full(n, file_id, np.int32), "frame": frame, "t": frame * hop / sr} | {k: f[k] for k in ("rms", "env", "centroid", "rolloff")})
                out["chroma"] = list(f["chroma"].T)
                if spectra:
                    out["mag"] = list(f["mag"].T.astype(np.float32))
                yield out

    schema = "file_id int, frame long, t double, rms double, env double, centroid double, rolloff double, chroma array<double>"
    return chunks(audio, hop).select("file_id", "sr", "hop", "first", "y").mapInPandas(run, schema + ", mag array<float>" * spectra)


def onset_strength(frames: DataFrame, hop: int = HOP) -> DataFrame:
    """frames whose env comes half a window later, 0 before: a centred window rises half of it before a sound begins."""
    return frames.withColumn("env", F.lag("env", N_FFT // (2 * hop), 0.0).over(Window.partitionBy("file_id").orderBy("frame")))


def compare(audio: DataFrame, notes: DataFrame, sr: int = SR, hop: int = HOP) -> DataFrame:
    """A row a frame of each recording: file_id, frame, length of the recording in samples, its env, and similarity, the
    cosine (0 at least; null where one is silent) of its constant-Q chroma and that of the notes (file_id, pitch, velocity, start_s,
    end_s) rendered to the recording's length. audio: whole recordings, or chunks with REACH samples beyond their frames.

    Chunks of recordings meet the notes that reach them, so each sample is rendered and transformed once, and frames leave as
    two numbers. Neither number depends on how loud the rendering is, so it isn't scaled."""
    own = chunks(audio, hop, REACH).withColumn("chunk", F.floor(F.col("first") / CHUNK).cast("long"))
    pieces = _pieces(notes.select("file_id", "pitch", "velocity", "start_s", "end_s"), sr, hop, REACH)

    def run(heard: pd.DataFrame, written: pd.DataFrame) -> pd.DataFrame:
        out = []
        for file_id, first, lead, length, y in zip(heard["file_id"], heard["first"], heard["lead"], heard["length"], heard["y"], strict=True):
            skip = int(first > 0)
            if lead != REACH + hop * skip:
                raise ValueError("chunks must have REACH samples beyond their frames")
            _, _, begin, end = bounds(first, length, hop, REACH)
            count, near = min(CHUNK, 1 + length // hop - first), REACH - N_FFT // 2
            env = flux(stft(y[near : len(y) - near], hop=hop, padded=True))[skip:]
            mine = _mix(written.sort_values(["start_s", "pitch"]), length, begin, end, sr)
            a, b = (pitch_classes(constant_q(np.asarray(x)[hop * skip :], count, sr, hop)) for x in (y, mine))
            size = np.sqrt((a**2).sum(axis=0) * (b**2).sum(axis=0))
            cosine = np.divide((a * b).sum(axis=0), size, out=np.full(count, np.nan), where=size > 0)
            out.append(pd.DataFrame({"file_id": file_id, "frame": first + np.arange(count), "length": length, "env": env, "similarity": cosine}))
        return pd.concat(out) if out else pd.DataFrame(columns=["file_id", "frame", "length", "env", "similarity"])

    found = own.groupBy("file_id", "chunk").cogroup(pieces.groupBy("file_id", "chunk")).applyInPandas(run, "file_id int, frame long, length long, env double, similarity double")
    return found.withColumn("similarity", F.when(F.col("similarity").isNotNull() & ~F.isnan("similarity"), F.greatest(F.lit(0.0), F.col("similarity"))))


def note_features(audio: DataFrame, notes: DataFrame, sr: int = SR, hop: int = HOP) -> DataFrame:
    """note_id, file_id, energy and slope of notes (note_id, file_id, pitch, start_s) in a recording.

    energy is the mean dB, against the recording's loudest bin, of the bins around the note's pitch in its onset frame, from five
    below the nearest to four above (all bins of the last frame for notes beyond it); slope is the rise of the onset strength
    over two frames, 0 in the last five. Each chunk of a recording is transformed once, together with the notes that start in
    it; only the bins that notes ask for, and the last frame, leave it."""
    own = chunks(audio, hop).withColumn("chunk", F.floor(F.col("first") / CHUNK).cast("long"))
    at = F.floor(F.col("start_s") * sr / hop).cast("long")
    asks = notes.select("note_id", "file_id", "pitch", at.alias("at"), F.floor(at / CHUNK).cast("long").alias("chunk"))

    def run(heard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        beyond = {"file_id": asked["file_id"], "frame": asked["at"], "note_id": asked["note_id"], "env": np.nan, "bins": None, "top": 0.0}
        out = [] if len(heard) else [pd.DataFrame(beyond)]
        for file_id, first, length, y in zip(heard["file_id"], heard["first"], heard["length"], heard["y"], strict=True):
            mag = stft(y, hop=hop, padded=True)
            env = flux(mag)[int(first > 0) :]
            mag = mag[:, int(first > 0) :].astype(np.float32)
            last, every = length // hop, [None] * len(env)
            if first + len(env) > last:
                every[-1] = mag[:, -1]
            out.append(pd.DataFrame({"file_id": file_id, "frame": first + np.arange(len(env)), "note_id": None, "env": env, "bins": every, "top": float(mag.max())}))
            b = np.minimum(np.ceil(440 * 2.0 ** ((asked["pitch"].to_numpy() - 69) / 12) * N_FFT / sr - 0.5), N_FFT // 2).astype(int)
            out.append(pd.DataFrame(beyond | {"bins": [mag[max(k - 5, 0) : k + 5, at - first] if at <= last else None for k, at in zip(b, asked["at"], strict=True)]}))
        return pd.concat([x for x in out if len(x)] or out[:1]).astype({"note_id": "Int64"})

    rows = own.groupBy("file_id", "chunk").cogroup(asks.groupBy("file_id", "chunk")).applyInPandas(run, "file_id int, frame long, note_id long, env double, bins array<float>, top double")
    whole = Window.partitionBy("file_id")
    order = whole.orderBy("frame", F.col("note_id").isNotNull(), "note_id")
    is_frame = F.col("note_id").isNull()
    rows = rows.withColumns({"top": F.max("top").over(whole), "n": F.max(F.when(is_frame, F.col("frame"))).over(whole) + 1})
    frame_order = Window.partitionBy("file_id", is_frame).orderBy("frame")
    rows = rows.withColumn("env", F.lag("env", N_FFT // (2 * hop), 0.0).over(frame_order))
    # a frame's slope is carried on to the notes behind it
    rows = rows.withColumn("slope", F.when(is_frame, F.col("env") - F.coalesce(F.lag("env", 2).over(frame_order), F.first("env").over(order))))
    rows = rows.withColumn("slope", F.last("slope", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.last(F.when(is_frame, F.col("bins")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("bins", F.coalesce("bins", final)).where("note_id is not null and bins is not null")
    db = F.transform("bins", lambda m: F.greatest(20 * F.log10(F.greatest(m.cast("double"), F.lit(1e-5)) / F.greatest(F.col("top"), F.lit(1e-5))), F.lit(-80.0)))
    energy = F.aggregate(db, F.lit(0.0), lambda s, v: s + v) / F.size(db)
    return rows.select("note_id", "file_id", energy.alias("energy"), F.when(F.col("frame") < F.col("n") - 5, F.col("slope")).otherwise(0.0).alias("slope"))


def band_energy(frames: DataFrame, notes: DataFrame, sr: int = SR) -> DataFrame:
    """Mean dB of the bins around each note's pitch in its onset frame, from five below the nearest to four above (all bins beyond the
    last frame): note_id, energy."""
    bin_ = F.least(F.ceil(440 * F.pow(F.lit(2.0), (F.col("pitch") - 69) / 12) * N_FFT / sr - 0.5), F.lit(N_FFT // 2)).cast("int")
    rows = notes.select("note_id", "file_id", F.floor(F.col("start_s") * sr / HOP).cast("long").alias("frame"), bin_.alias("bin"))
    last = frames.groupBy("file_id").agg(F.max("frame").alias("last"), F.max(F.array_max("mag")).alias("top"))
    rows = rows.join(last, "file_id").withColumn("past", F.col("frame") > F.col("last")).withColumn("frame", F.least("frame", "last"))
    rows = rows.join(frames.select("file_id", "frame", "mag"), ["file_id", "frame"])
    part = F.when(F.col("past"), F.col("mag")).otherwise(F.slice("mag", F.greatest(F.col("bin") - 5, F.lit(0)) + 1, F.col("bin") + 5 - F.greatest(F.col("bin") - 5, F.lit(0))))
    db = F.transform(part, lambda m: F.greatest(20 * F.log10(F.greatest(m.cast("double"), F.lit(1e-5)) / F.greatest(F.col("top").cast("double"), F.lit(1e-5))), F.lit(-80.0)))
    return rows.select("note_id", (F.aggregate(db, F.lit(0.0), lambda s, v: s + v) / F.size(db)).alias("energy"))


def available(*modules: str) -> bool:
    """Whether a backend's modules can be imported."""
    return all(importlib.util.find_spec(m) is not None for m in modules)


def separate(audio: DataFrame, backend: Callable[[DataFrame], DataFrame] | None = None, needs: tuple[str, ...] = ()) -> DataFrame:
    """Source separation by a backend; the recording itself without one, or where what it needs is missing."""
    return backend(audio) if backend and available(*needs) else audio


def transcribe(audio: DataFrame, onset: float = 0.5, min_ms: float = 127.7, low: int = 21, high: int = 108, backend: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Notes of recordings by a backend, or by a plain salience of pitch bins, which is not equal to any trained model:
    file_id, pitch, velocity, start_s, end_s."""
    if backend:
        return backend(audio)

    audio = chunks(audio)

    def spectrum(first: int, hop: int, y: np.ndarray) -> np.ndarray:
        return stft(y, hop=hop, padded=True)[:, int(first > 0) :]

    def loudest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file_id": batch["file_id"], "top": [float(spectrum(*row).max()) for row in zip(batch["first"], batch["hop"], batch["y"], strict=True)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, sr, hop, first, y, top in zip(batch["file_id"], batch["sr"], batch["hop"], batch["first"], batch["y"], batch["top"], strict=True):
                mag = spectrum(first, hop, y)
                out = []
                for pitch in range(low, high + 1):
                    b = int(round(440 * 2 ** ((pitch - 69) / 12) * N_FFT / sr))
                    if not 1 <= b < len(mag) - 1:
                        continue
                    x = mag[b] / (top or 1.0)
                    on = (x >= onset * 0.5) & (mag[b] >= mag[b - 1]) & (mag[b] >= mag[b + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0]))))
                    out += [(file_id, pitch, hop / sr, first + i, first + j, x[i:j].max()) for i, j in zip(edge[::2], edge[1::2], strict=True)]
                yield pd.DataFrame(out, columns=["file_id", "pitch", "step", "i", "j", "loud"])

    tops = audio.select("file_id", "first", "hop", "y").mapInPandas(loudest, "file_id int, top double").groupBy("file_id").agg(F.max("top").alias("top"))
    runs = audio.join(tops, "file_id").select("file_id", "sr", "hop", "first", "y", "top").mapInPandas(run, "file_id int, pitch int, step double, i long, j long, loud double")
    # a note that goes on in the next chunk is one
    order = Window.partitionBy("file_id", "pitch").orderBy("i")
    runs = runs.withColumn("new", F.coalesce(F.col("i") > F.lag("j").over(order), F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(order))
    notes = runs.groupBy("file_id", "pitch", "nth").agg(F.min("i").alias("i"), F.max("j").alias("j"), F.max("loud").alias("loud"), F.first("step").alias("step"))
    notes = notes.where((F.col("j") - F.col("i")) * F.col("step") * 1000 >= min_ms)
    return notes.select("file_id", "pitch", F.least(F.lit(127), F.floor(30 + 97 * F.col("loud"))).cast("int").alias("velocity"), (F.col("i") * F.col("step")).alias("start_s"), (F.col("j") * F.col("step")).alias("end_s"))
