"""Audio features of 8-bit recordings.

A recording is stored as a RIFF/WAVE file. Its samples are resampled by a
polyphase filter, cut into overlapping windows for a log-mel filterbank, and
segmented by frame energy with hysteresis. Features have a fixed shape, so
that they are stored as fixed-shape Arrow tensors, beside the spans in seconds.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, release

#: Stored rate, and the ratio by which it is resampled.
RATE, UP, DOWN = 24_000, 2, 3
#: Filter taps of each phase.
TAPS = 16
#: Window and hop in resampled samples, and the length of its Fourier transform.
WINDOW, HOP, TRANSFORM = 400, 200, 512
#: Shape of the feature tensor: parts of the recording's time, mel bands.
PARTS, BANDS = 8, 24
#: Energy above the recording's median, in decibels, at which a span begins and below which it ends.
RISE, FALL = 3.0, 1.0
#: Payloads are padded to a positive multiple of this many bytes by PAD.
ALIGN, PAD = 576, 255
#: Windows of which spectra are held at once.
FRAMES_AT_ONCE = 4096

_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(ALIGN, -(-len(text) // ALIGN) * ALIGN) - len(text))


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file of unsigned 8-bit samples; an odd number gets the format's pad byte."""
    odd = len(samples) % 2
    return _HEADER.pack(b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * odd


def from_wave(stored: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file."""
    riff, _, wave, _, _, kind, channels, rate, _, _, bits, _, size = _HEADER.unpack_from(stored)
    if (riff, wave, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(stored) < _HEADER.size + size:
        raise ValueError("not a mono 8-bit WAVE file")
    return rate, bytes(memoryview(stored)[_HEADER.size : _HEADER.size + size])


@functools.cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """The windowed-sinc low-pass filter, a row for each phase."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    low = np.sinc(t * cutoff) * np.hamming(n)
    low *= up / low.sum()
    return np.ascontiguousarray(low.reshape(taps, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """``x`` at up / down times its rate: each output is the product of one phase
    of the filter with ``taps`` inputs; no output between is ever computed."""
    n = -(-len(x) * up // down)
    bank = _phases(up, down, taps)
    padded = np.concatenate((np.zeros(taps // 2, np.float32), x.astype(np.float32), np.zeros(taps // 2, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for k in range(up):  # outputs k, k + up, ... have the same phase and start `down` inputs apart
        own = len(range(k, n, up))
        first = k * down // up
        out[k::up] = windows[first : first + (own - 1) * down + 1 : down] @ bank[k * down % up] if own else 0
    return out


@functools.cache
def _mel_bank(rate: float) -> np.ndarray:
    """Triangles equally spaced on the mel scale, a column for each band."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(TRANSFORM, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = np.hanning(WINDOW).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each overlapping window: the log energies of the mel bands, and its level in decibels.
    Silence fills up the last window, so that every sample is in one."""
    hops = max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.concatenate((x, np.zeros(WINDOW + hops * HOP - len(x), np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    bank = _mel_bank(rate)
    bands, level = [], []
    for start in range(0, len(windows), FRAMES_AT_ONCE):
        own = windows[start : start + FRAMES_AT_ONCE]
        level.append(10 * np.log10(np.einsum("ij,ij->i", own, own) / WINDOW + 1e-8))
        spectrum = np.fft.rfft(own * _HANN, TRANSFORM)
        bands.append(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6))
    return np.concatenate(bands), np.concatenate(level)


def segment(level: np.ndarray, rise: float = RISE, fall: float = FALL) -> np.ndarray:
    """First and last-plus-one window of each loud span: one begins where the level
    passes the median by ``rise`` and lasts until it is less than ``fall`` over it."""
    base = np.median(level)
    mark = np.where(level >= base + rise, 1, np.where(level < base + fall, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(known >= 0, mark[np.maximum(known, 0)], 0)
    edges = np.diff(np.concatenate(([0], on, [0])))
    return np.stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)), axis=1)


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """A (PARTS, BANDS) tensor of mean log-mel energies and the loud spans in
    seconds. All from this recording alone, so equal samples give equal values."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    new_rate = rate * UP / DOWN
    bands, level = log_mel(y, new_rate)
    running = np.concatenate((np.zeros((1, BANDS)), np.cumsum(bands, axis=0, dtype=np.float64)))
    cuts = np.arange(PARTS + 1) * len(bands) // PARTS
    stop = np.maximum(cuts[1:], cuts[:-1] + 1)
    tensor = ((running[stop] - running[cuts[:-1]]) / (stop - cuts[:-1])[:, None]).astype(np.float32)
    spans = segment(level)
    return tensor, np.stack((spans[:, 0] * HOP, (spans[:, 1] - 1) * HOP + WINDOW), axis=1) / new_rate


def feature_text(tensor: np.ndarray, spans: np.ndarray) -> str:
    """The features as JSON: the tensor in hundredths, the spans in milliseconds."""
    return json.dumps({"mel": np.rint(tensor * 100).astype(int).tolist(), "spans": np.rint(spans * 1000).astype(int).tolist()}, separators=(",", ":"))


TENSOR = pa.fixed_shape_tensor(pa.float32(), [PARTS, BANDS], dim_names=["part", "band"])
#: Bytes of recordings whose features are stored together.
FILE_BYTES = 8_000_000
#: What a stored file of features has for each recording, the tensors with their type and shape.
STORED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("mel", TENSOR), ("spans", pa.list_(pa.list_(pa.float64(), 2))),
])


_MEDIA = "doc_id long, n_bytes long, media binary"
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, mel array<float>, spans array<array<double>>, feature string"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes (null: none), padded, as the samples of a written WAVE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([to_wave(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(slim.mapInArrow(run, _MEDIA), "media", compression="zstd")


def store_features(media: DataFrame) -> DataFrame:
    """Files of features, one per row, in the cells of a written table: Arrow streams
    of STORED, in which features are fixed-shape tensors beside their time spans.
    All is computed from the recordings' stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "media", FILE_BYTES):
                rows = []
                for cell in part.column("media"):
                    stored = cell.as_buffer().to_pybytes()
                    rate, payload = from_wave(stored)
                    tensor, spans = features(payload, rate)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), tensor, spans.tolist()))
                *known, tensors, spans = zip(*rows, strict=True)
                mel = pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack(tensors), dim_names=TENSOR.dim_names)
                columns = [part.column("doc_id"), part.column("n_bytes"), *[pa.array(v, t) for v, t in zip(known, STORED.types[2:7], strict=True)], mel, pa.array(spans, STORED.types[8])]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, STORED) as file:
                    file.write_batch(pa.RecordBatch.from_arrays(columns, schema=STORED))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    return materialize(media.mapInArrow(run, "data binary"), "media-features", compression="zstd")


def read_features(files: DataFrame) -> DataFrame:
    """One row per recording of the stored files: sizes and digests, the tensor as
    a list in row order (``mel``), ``spans``, and both as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("data"):
                for own in pa.ipc.open_stream(cell.as_buffer()):
                    if own.schema != STORED:
                        raise ValueError("not a file of features")
                    tensors = own.column("mel").to_numpy_ndarray()
                    spans = own.column("spans")
                    texts = [feature_text(t, np.array(x, np.float64).reshape(-1, 2)) for t, x in zip(tensors, spans.to_pylist(), strict=True)]
                    lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * (PARTS * BANDS), pa.array(tensors.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*own.columns[:7], lists, spans.cast(pa.list_(pa.list_(pa.float64()))), pa.array(texts, pa.string())], [*STORED.names, "feature"])

    return files.mapInArrow(run, _FEATURES)


def audio_features(docs: DataFrame, **columns) -> DataFrame:
    """Stores every text of ``docs`` as a recording, reads it back, stores its
    features as fixed-shape tensors and reads these back: one row per row of
    ``docs``. Null and empty texts are one block of padding; repeated rows are
    stored each; null ids are kept; an empty table gives no rows. Other columns of ``docs`` are not looked at."""
    media = store_media(docs, **columns)
    files = store_features(media)
    release(media)
    return read_features(files)
