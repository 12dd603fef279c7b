"""Audio columns: 8-bit wave files, polyphase resampling, log-mel filterbanks and energy segments.

A payload is stored as the samples of a mono 8-bit PCM wave file in a written table, so it comes back byte for byte.
Features are computed from the stored bytes: the samples are resampled by a polyphase filter, cut into overlapped
frames, turned into log-mel energies, and segmented by hysteresis over the frame energy. The log-mel frames are stored
as clips of one fixed shape (CLIP_FRAMES x MELS half floats, the last clip filled up with 0), each with its time span;
``tensor_batch`` gives them as a column of Arrow's fixed-shape tensors.

A null or empty text is a payload of 64 zero bytes. An empty table gives no rows; repeated rows give repeated
results; equal payloads give equal features. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.llm.common import map_rows, stored, table, texts

BLOCK = 64
RATE = 16_000
UP, DOWN = 1, 2
TAPS = 16
FRAME, HOP, MELS = 256, 128, 32
CLIP_FRAMES = 64
#: Decibels above the mean frame energy at which a segment starts and below which it ends.
START_DB, END_DB = 1.0, -1.0
MIN_SEGMENT = 3
#: Samples resampled at once.
PART = 1 << 18


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, the bytes padded with 0 to a positive multiple of BLOCK)"""
    data = text.encode("utf-8")
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


def wave_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF wave file of unsigned 8-bit mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) & 1)


def wave_samples(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a wave file; walks over its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("mono 8-bit samples are expected")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def filter_phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """(up, taps) rows of a windowed sinc, one row for each phase of the output."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(samples: np.ndarray, phases: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: output m is the dot product of phase (m * down) % up with the inputs before
    (m * down) // up, so no zeros are inserted and no output is computed that is dropped later."""
    taps = phases.shape[1]
    count = -(-len(samples) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), samples, np.zeros(taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(count, np.float32)
    for phase in range(up):
        m = np.arange(phase, count, up)  # outputs whose phase is the same
        row = phases[(phase * down) % up]
        step = down
        start = (phase * down) // up
        for at in range(0, len(m), PART):
            n = min(PART, len(m) - at)
            first = start + at * step
            out[phase + at * up : phase + (at + n) * up : up] = windows[first : first + n * step : step][:n] @ row
    return out


def mel_matrix(rate: float, bins: int = FRAME // 2 + 1, mels: int = MELS) -> np.ndarray:
    """(bins, mels) triangles, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(signal: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies, frame energies in dB)"""
    frames = max(1, 1 + -(-(len(signal) - FRAME) // HOP)) if len(signal) > FRAME else 1
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(signal)] = signal
    windows = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    shape = np.hanning(FRAME).astype(np.float32)
    mel, energy = np.empty((frames, weights.shape[1]), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, 2048):
        part = windows[at : at + 2048]
        spectrum = np.fft.rfft(part * shape, axis=1)
        power = spectrum.real.astype(np.float32) ** 2 + spectrum.imag.astype(np.float32) ** 2
        mel[at : at + 2048] = np.log(power @ weights + 1e-6)
        energy[at : at + 2048] = 10 * np.log10((part * part).mean(axis=1) + 1e-6)
    return mel, energy


def hysteresis_segments(energy: np.ndarray, start_db: float = START_DB, end_db: float = END_DB) -> list[tuple[int, int]]:
    """(first, end) frames: a segment starts above the mean by start_db and lasts until the energy is under
    the mean by end_db; shorter ones than MIN_SEGMENT frames are dropped."""
    level = energy - energy.mean()
    mark = np.where(level >= start_db, 1, np.where(level < end_db, -1, 0))
    known = np.flatnonzero(mark)
    state = np.zeros(len(mark), bool)
    if len(known):  # each frame takes the last mark at or before it
        last = np.searchsorted(known, np.arange(len(mark)), side="right") - 1
        state = (last >= 0) & (mark[known[np.maximum(last, 0)]] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= MIN_SEGMENT]


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a wave file in a binary column."""

    def task():
        def step(block):
            made = [payload_of(t) for t in block["text"]]
            return {"doc_id": block["doc_id"], "n_bytes": [n for n, _ in made], "media": [wave_bytes(p) for _, p in made]}

        return step

    return map_rows(texts(docs), task, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, segments array<struct<start_s:double,end_s:double>>, "
    "clips array<struct<start_s:double,end_s:double,log_mel:binary>>"
)


def audio_features(media: DataFrame) -> DataFrame:
    """Reads (doc_id, n_bytes, media) back: digests, segments, and clips of one shape with their time spans."""

    def task():
        phases = filter_phases()
        weights: dict[float, np.ndarray] = {}

        def step(block):
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments", "clips"]
            out = {"doc_id": block["doc_id"], "n_bytes": block["n_bytes"]} | {n: [] for n in names}
            for stored in block["media"]:
                rate, samples = wave_samples(stored)
                new_rate = rate * UP / DOWN
                if new_rate not in weights:
                    weights[new_rate] = mel_matrix(new_rate)
                signal = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128, phases)
                mel, energy = log_mel(signal, weights[new_rate])
                segments = hysteresis_segments(energy)
                second = HOP / new_rate
                coarse = np.round(np.concatenate([mel.mean(axis=0), mel.std(axis=0)]), 1) + 0.0
                spans = [{"start_s": a * second, "end_s": b * second} for a, b in segments]
                out["payload_bytes"].append(len(samples))
                out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
                out["tail_crc32"].append(zlib.crc32(samples[-BLOCK:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(
                    f"frames={len(mel)};segments={len(segments)};active={sum(b - a for a, b in segments)};"
                    f"mel={','.join(f'{x:.1f}' for x in coarse)}"
                )
                out["segments"].append(spans)
                clips = np.zeros((-(-len(mel) // CLIP_FRAMES) * CLIP_FRAMES, MELS), "<f2")
                clips[: len(mel)] = mel
                out["clips"].append([
                    {"start_s": at * second, "end_s": min(at + CLIP_FRAMES, len(mel)) * second, "log_mel": clips[at : at + CLIP_FRAMES].tobytes()}
                    for at in range(0, len(mel), CLIP_FRAMES)
                ])
            return out

        return step

    return map_rows(media, task, FEATURES, rows=64)


def clip_rows(features: DataFrame) -> DataFrame:
    """One row for each clip: (doc_id, clip, start_s, end_s, log_mel), log_mel of CLIP_FRAMES * MELS half floats."""
    return features.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def tensor_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The same batch of clip_rows with log_mel as a column of Arrow fixed-shape tensors."""
    at = batch.schema.get_field_index("log_mel")
    values = np.frombuffer(b"".join(batch.column(at).to_pylist()), "<f2").reshape(-1, CLIP_FRAMES, MELS)
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(values)
    return batch.set_column(at, pa.field("log_mel", tensors.type), tensors)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, the segments, and the number and digest of the stored clips of every document."""
    media = stored(store_media(table(spark, sf_dir, "documents")), "media")
    features = stored(audio_features(media), "audio")
    digests = F.transform("clips", lambda c: F.sha2(c["log_mel"], 256))
    return features.withColumn("n_clips", F.size("clips").cast("long")).withColumn("clips_sha256", F.sha2(F.array_join(digests, ","), 256)).drop("clips")
