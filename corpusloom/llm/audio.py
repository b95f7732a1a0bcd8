"""Media columns: audio features of 8-bit PCM.

The stored form is a RIFF/WAVE file of mono 8-bit samples. Features: polyphase resampling, log-mel
energies of overlapping frames, and speech-like segments by two energy thresholds (hysteresis),
kept as fixed-shape Arrow tensors with the time spans they cover.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.arrow import as_bytes, crc, keyed

BLOCK = 192


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 16000
    up: int = 2
    down: int = 5
    taps: int = 16  # of each phase
    frame: int = 160
    hop: int = 64
    fft: int = 256
    mels: int = 32
    tensor_frames: int = 96
    enter_db: float = 1.5  # above the median frame, to open a segment
    leave_db: float = 0.5  # above it, to stay in one
    min_frames: int = 5

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


def encode_wav(payload: bytes, rate: int) -> bytes:
    """The payload as samples of a mono 8-bit WAVE file; nothing is lost."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Bytes 32 appended up to a positive multiple of ``block``."""
    return data + b" " * (max(block, -(-len(data) // block) * block) - len(data))


class Features:
    """Filters for one configuration; methods are pure functions of samples."""

    def __init__(self, config: AudioConfig):
        self.c = c = config
        n = c.taps * c.up
        t = np.arange(n) - (n - 1) / 2
        cutoff = 0.5 / max(c.up, c.down)
        ideal = 2 * cutoff * np.sinc(2 * cutoff * t) * np.hanning(n + 2)[1:-1] * c.up
        self.phases = [ideal[p :: c.up][::-1].astype(np.float32).copy() for p in range(c.up)]
        top = 2595 * np.log10(1 + c.out_rate / 2 / 700)
        edges = 700 * (10 ** (np.linspace(0, top, c.mels + 2) / 2595) - 1)
        hz = np.arange(c.fft // 2 + 1) * c.out_rate / c.fft
        low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
        self.mel = np.maximum(0, np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid))).T.astype(np.float32)
        self.window = np.hanning(c.frame).astype(np.float32)

    def resample(self, x: np.ndarray) -> np.ndarray:
        """Rational-rate resampling: each output sample is one phase of the filter over the input."""
        c = self.c
        n_out = -(-len(x) * c.up // c.down)
        padded = np.zeros(len(x) + 2 * c.taps + c.down, dtype=np.float32)
        padded[c.taps : c.taps + len(x)] = x
        out = np.zeros(n_out, dtype=np.float32)
        views = np.lib.stride_tricks.sliding_window_view(padded, c.taps)
        for first in range(c.up):
            position = first * c.down
            phase, begin = position % c.up, position // c.up + c.taps // 2 + 1
            count = len(range(first, n_out, c.up))
            out[first :: c.up] = views[begin : begin + count * c.down : c.down][:count] @ self.phases[phase]
        return out

    def log_mel(self, y: np.ndarray) -> np.ndarray:
        """(frames, mels) natural logs, in chunks so that memory is bounded for any length."""
        c = self.c
        n = max(1, -(-max(0, len(y) - c.frame) // c.hop) + 1)
        padded = np.zeros((n - 1) * c.hop + c.frame, dtype=np.float32)
        padded[: min(len(y), len(padded))] = y[: len(padded)]
        frames = np.lib.stride_tricks.sliding_window_view(padded, c.frame)[:: c.hop]
        out = np.empty((n, c.mels), dtype=np.float32)
        for at in range(0, n, 4096):
            spectrum = np.fft.rfft(frames[at : at + 4096] * self.window, c.fft)
            power = spectrum.real**2 + spectrum.imag**2
            out[at : at + 4096] = np.log(power.astype(np.float32) @ self.mel + np.float32(1e-6))
        return out

    def segments(self, mel: np.ndarray) -> list[tuple[int, int]]:
        """(first frame, end frame) of runs over the low threshold that reach the high one."""
        c = self.c
        energy = mel.mean(axis=1) * (10 / np.log(10))
        floor = np.median(energy)
        low = energy > floor + c.leave_db
        edge = np.flatnonzero(np.diff(np.concatenate([[0], low.view(np.int8), [0]])))
        peaks = np.concatenate([[0], np.cumsum(energy > floor + c.enter_db)])
        return [(int(a), int(b)) for a, b in zip(edge[0::2], edge[1::2], strict=True) if b - a >= c.min_frames and peaks[b] > peaks[a]]

    def tensors(self, stored: bytes) -> tuple[pa.RecordBatch, list[tuple[int, int]]]:
        """Rows (start_ms, end_ms, n_frames, tensor) of a stored file, and its segments in ms."""
        c = self.c
        x = np.frombuffer(decode_wav(stored), dtype=np.uint8).astype(np.float32)
        mel = self.log_mel(self.resample((x - 128) / 128))
        n = len(mel)
        rows = -(-n // c.tensor_frames)
        full = np.zeros((rows * c.tensor_frames, c.mels), dtype=np.float32)
        full[:n] = mel
        first = np.arange(rows) * c.tensor_frames
        last = np.minimum(first + c.tensor_frames, n)
        ms = lambda f: np.asarray(f) * c.hop * 1000 // c.out_rate
        tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(rows, c.tensor_frames, c.mels))
        batch = pa.RecordBatch.from_arrays([pa.array(ms(first), pa.int64()), pa.array(ms(last), pa.int64()), pa.array(last - first, pa.int64()), tensor], names=["start_ms", "end_ms", "n_frames", "tensor"])
        return batch, [(int(ms(a)), int(ms(b))) for a, b in self.segments(mel)]


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(data)) as reader:
        return reader.read_next_batch()


def summary(tensors: pa.RecordBatch, segments: list[tuple[int, int]]) -> str:
    """Frames, mean log-mel energy of each band in quarters, and segments, from what was stored."""
    frames = tensors.column(2).to_numpy()
    data = tensors.column(3).to_numpy_ndarray()
    total = int(frames.sum())
    means = np.rint(data.reshape(-1, data.shape[-1]).sum(axis=0, dtype=np.float64) / max(1, total) * 4).astype(int)
    spans = hashlib.md5(repr(segments).encode()).hexdigest()[:12]
    return f"frames={total};mel={','.join(map(str, means))};segments={len(segments)};spans={spans};end_ms={int(tensors.column(1)[-1].as_py())}"


_FIELDS = [("doc_id", None), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary()), ("tensors", pa.binary()), ("segments", pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])))]
_DDL = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FULL = ", media binary, tensors binary, segments array<struct<start_ms:bigint,end_ms:bigint>>"


def audio_columns(docs: DataFrame, config: AudioConfig = AudioConfig(), with_media: bool = True) -> DataFrame:
    """Stores each text's bytes as audio and computes its features, one row for each row of ``docs``.

    Null and empty texts are one block of spaces. ``with_media``: also the WAVE file, the log-mel
    tensors (an Arrow IPC stream of fixed-shape tensors with time spans) and the segments; without
    it only what is derived from them. Equal texts give equal values. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(config)
        for batch in batches:
            size, at, raw = 0, 0, as_bytes(batch, "text")
            rows: list[tuple] = []
            ids = batch.column(0)
            for i, text in enumerate(raw):
                text = text or b""
                stored = encode_wav(pad(text), config.rate)
                payload = decode_wav(stored)
                kept, segments = make.tensors(stored)
                ipc = to_ipc(kept)
                row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), crc(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), summary(from_ipc(ipc), segments))
                rows.append(row + ((stored, ipc, [{"start_ms": a, "end_ms": b} for a, b in segments]) if with_media else ()))
                size += len(stored) + len(ipc) if with_media else 300
                if size > 16 << 20 or i + 1 == len(raw):
                    columns = list(zip(*rows, strict=True))
                    fields = _FIELDS[1 : 1 + len(columns)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), *[pa.array(c, f[1]) for c, f in zip(columns, fields, strict=True)]], names=["doc_id", *[f[0] for f in fields]])
                    size, at, rows = 0, i + 1, []

    return docs.select("doc_id", "text").mapInArrow(run, keyed(docs, _DDL + (_FULL if with_media else "")))
