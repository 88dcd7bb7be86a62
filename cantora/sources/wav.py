"""Recordings: WAV files (PCM of 8 to 32 bits, floats) to mono samples, band-limited resampling, with an optional prefix."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cantora.operators import signal
from cantora.sources import layout

#: Zero crossings of the resampling filter on each side.
CROSSINGS = 24


@dataclass
class Wav:
    """Where a file's samples lie; part() decodes some of them."""

    content: bytes
    rate: int
    channels: int
    kind: str  # numpy's name of a sample; u3 stands for 24 bits
    begin: int
    frames: int

    def part(self, first: int, last: int) -> np.ndarray:
        """Samples first to last, the mean of all channels, 0 outside the file."""
        i, j = min(max(first, 0), self.frames), min(max(last, 0), self.frames)
        width = int(self.kind[-1]) * self.channels
        raw = self.content[self.begin + i * width : self.begin + j * width]
        if self.kind == "u3":
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            y = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
        else:
            y = np.frombuffer(raw, f"<{self.kind}").astype(np.float64)
            y = y / 128 - 1 if self.kind == "u1" else y if self.kind[0] == "f" else y / float(1 << (8 * int(self.kind[1]) - 1))
        return np.pad(y.reshape(-1, self.channels).mean(axis=1), (i - first if i < j else 0, last - first - (j - first if i < j else 0)))


def header(content: bytes) -> Wav:
    """ValueError for what isn't a WAV file of a known kind."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = struct.unpack("<4sI", content[at : at + 8])
        if name == b"fmt ":
            if size < 16 or at + 24 > len(content):
                raise ValueError("a short format")
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
            if code == 0xFFFE and size >= 26:
                code = struct.unpack("<H", content[at + 32 : at + 34])[0]
            form = {(1, 8): "u1", (1, 16): "i2", (1, 24): "u3", (1, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((code, bits))
            if not form or not channels or not rate:
                raise ValueError(f"format {code} of {bits} bits")
        elif name == b"data":
            if not form:
                raise ValueError("samples before their format")
            size = min(size, len(content) - at - 8)  # a stream's length may be unknown
            return Wav(content, rate, channels, form, at + 8, size // (int(form[1]) * channels))
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(16)
def _filters(up: int, down: int) -> tuple[np.ndarray, int]:
    """Taps of each of ``up`` phases, and how many lie before a place: a sinc cut at the lower of both rates, in a Kaiser window."""
    cut = min(1.0, up / down)
    half = int(np.ceil(CROSSINGS / cut))
    at = np.arange(-half + 1, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    taps = 0.96 * cut * np.sinc(0.96 * cut * at) * np.i0(9 * np.sqrt(np.maximum(0, 1 - (at / half) ** 2))) / np.i0(9)
    return taps / taps.sum(axis=1, keepdims=True), half - 1


def resampled(wav: Wav, sr: int, first: int, last: int) -> np.ndarray:
    """Samples first to last at another rate; the same whatever the parts."""
    if wav.rate == sr:
        return wav.part(first, last)
    common = gcd(wav.rate, sr)
    up, down = sr // common, wav.rate // common
    taps, before = _filters(up, down)
    n = np.arange(first, last)
    base = n * down // up
    low = int(base[0]) - before if len(n) else 0
    y = wav.part(low, int(base[-1]) - before + taps.shape[1]) if len(n) else np.empty(0)
    out = np.empty(len(n))
    for phase in np.unique(n * down % up):
        mine = np.flatnonzero(n * down % up == phase)
        windows = np.lib.stride_tricks.sliding_window_view(y, taps.shape[1])[base[mine] - before - low]
        out[mine] = windows @ taps[phase]
    return out


def _length(wav: Wav, sr: int, seconds: float | None) -> int:
    frames = wav.frames if seconds is None else min(wav.frames, int(seconds * wav.rate))
    return frames if wav.rate == sr else int(frames * sr / wav.rate)


def decode(content: bytes, sr: int = 22_050, seconds: float | None = None) -> np.ndarray:
    wav = header(content)
    return resampled(wav, sr, 0, _length(wav, sr, seconds)).astype(np.float32)


def encode(y: np.ndarray, sr: int = 22_050, floats: bool = False) -> bytes:
    body = np.asarray(y, "<f4").tobytes() if floats else (np.clip(y, -1, 1) * 32767).astype("<i2").tobytes()
    width = 4 if floats else 2
    head = struct.pack("<HHIIHH", 3 if floats else 1, 1, sr, sr * width, width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def from_content(files: DataFrame, sr: int = 22_050, seconds: float | None = None) -> DataFrame:
    """file_id, sr, y of rows (file_id, content); y is null for content that can't be read."""

    def read(content: bytes | None) -> np.ndarray | None:
        try:
            return decode(content or b"", sr, seconds)
        except ValueError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file_id": batch["file_id"], "sr": sr, "y": [read(c) for c in batch["content"]]})

    return files.select("file_id", "content").mapInPandas(run, "file_id int, sr int, y array<float>")


def chunks(files: DataFrame, sr: int = signal.SR, hop: int = signal.HOP, seconds: float | None = None, beyond: int = signal.N_FFT // 2) -> DataFrame:
    """Chunks of recordings, as signal.chunks() gives them, straight from rows (file_id, content): a chunk's samples are decoded
    and resampled alone, so that no recording is held as numbers. Content that can't be read has no chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    wav = header(content or b"")
                except ValueError:
                    continue
                length = _length(wav, sr, seconds)
                for first in range(0, 1 + length // hop, signal.CHUNK):
                    lead, samples, begin, end = signal.bounds(first, length, hop, beyond)
                    part = np.pad(resampled(wav, sr, max(begin, 0), min(end, length)), (max(-begin, 0), max(end - length, 0)))
                    yield pd.DataFrame({"file_id": [file_id], "sr": sr, "hop": hop, "first": first, "lead": lead, "samples": samples, "length": length, "y": [part.astype(np.float32)]})

    return files.select("file_id", "content").mapInPandas(run, signal.CHUNKS)


def read(spark: SparkSession, path: str, chunked: bool = False, **options) -> DataFrame:
    """Recordings of the WAV files of a path, numbered by layout.numbered(), whole or in chunks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return (chunks if chunked else from_content)(files.join(layout.numbered(files), "path"), **options)
