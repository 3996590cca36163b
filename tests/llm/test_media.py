import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexaloom.llm import media


def test_wave_round_trip():
    for n in (0, 1, 576, 577):
        samples = bytes(random.Random(n).randrange(256) for _ in range(n))
        stored = media.to_wave(samples)
        assert media.from_wave(stored) == (media.RATE, samples) and len(stored) % 2 == 0
        assert int.from_bytes(stored[4:8], "little") == len(stored) - 8
    with pytest.raises(ValueError):
        media.from_wave(b"x" * 60)


def test_wave_is_what_the_standard_library_reads(tmp_path):
    import wave

    path = tmp_path / "a.wav"
    path.write_bytes(media.to_wave(bytes(range(256))))
    with wave.open(str(path)) as file:
        assert (file.getnchannels(), file.getsampwidth(), file.getframerate()) == (1, 1, media.RATE)
        assert file.readframes(256) == bytes(range(256))


def test_resampling_is_filtering_between_zeros():
    x = np.random.default_rng(0).normal(size=1000).astype(np.float32)
    bank = media._phases(media.UP, media.DOWN, media.TAPS)
    spread = np.zeros(len(x) * media.UP)
    spread[:: media.UP] = x
    low = bank[:, ::-1].T.reshape(-1)
    full = np.convolve(spread, low)
    shift = (media.TAPS // 2 - 1) * media.UP
    want = full[shift:][:: media.DOWN][: len(x) * media.UP // media.DOWN]
    got = media.resample(x)
    assert len(got) == -(-len(x) * media.UP // media.DOWN)
    assert np.allclose(got[: len(want)], want, atol=1e-4)


def test_a_tone_stays_a_tone():
    t = np.arange(24_000) / 24_000
    y = media.resample(np.sin(2 * np.pi * 1000 * t))
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert len(y) == 16_000 and abs(int(spectrum.argmax()) - 1000) <= 1
    bands, _ = media.log_mel(y, 16_000)
    assert len(set(bands[5:-5].argmax(axis=1).tolist())) == 1


def test_hysteresis():
    def slow(level):
        base, on, out = np.median(level), False, []
        for i, v in enumerate(level):
            was, on = on, v >= base + media.RISE or (on and v >= base + media.FALL)
            if on and not was:
                out.append([i, i])
            if on:
                out[-1][1] = i + 1
        return out

    rng = np.random.default_rng(2)
    for _ in range(200):
        level = rng.normal(0, 3, rng.integers(1, 60))
        assert media.segment(level).tolist() == slow(level)


def plain_mel(y):
    """The tensor by loops: windows with silence behind the last sample, a Fourier sum per window, triangles per band, means per part."""
    rate = media.RATE * media.UP / media.DOWN
    starts = [0]
    while starts[-1] + media.WINDOW < len(y):
        starts.append(starts[-1] + media.HOP)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(60), mel(rate / 2), media.BANDS + 2)]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.WINDOW) / (media.WINDOW - 1))
    frames = []
    for s in starts:
        own = np.zeros(media.WINDOW)
        own[: len(y[s : s + media.WINDOW])] = y[s : s + media.WINDOW]
        power = np.abs(np.fft.rfft(own * hann, media.TRANSFORM)) ** 2
        bands = []
        for low, mid, high in zip(edges, edges[1:], edges[2:]):
            total = 0.0
            for k, p in enumerate(power):
                f = k * rate / media.TRANSFORM
                if low < f < high:
                    total += p * ((f - low) / (mid - low) if f <= mid else (high - f) / (high - mid))
            bands.append(np.log(total + 1e-6))
        frames.append(bands)
    cuts = [k * len(frames) // media.PARTS for k in range(media.PARTS + 1)]
    return np.array([np.mean(frames[a : max(b, a + 1)], axis=0) for a, b in zip(cuts, cuts[1:])])


def test_features_of_recordings(spark):
    rows = [(1, "Grüße"), (2, None), (3, ""), (3, ""), (None, "x" * 576), (4, "long " * 40_000), (5, "Grüße")]
    docs = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, feature string, media binary")
    got = media.audio_features(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.to_wave(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        parsed = json.loads(r["feature"])
        assert np.array(parsed["mel"]).shape == (media.PARTS, media.BANDS) and len(parsed["spans"]) == len(r["spans"])
        assert all(a < b for a, b in r["spans"])
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["feature"]) == r["feature"]
    files = media.store_features(media.store_media(docs)).collect()
    stored = [batch for f in files for batch in pa.ipc.open_stream(f["data"])]
    assert all(batch.schema.field("mel").type == media.TENSOR for batch in stored)
    tensors = np.concatenate([batch.column("mel").to_numpy_ndarray() for batch in stored])
    assert tensors.shape == (len(rows), media.PARTS, media.BANDS)
    assert sorted(map(tuple, tensors.reshape(len(rows), -1).tolist())) == sorted(tuple(r["mel"]) for r in got)
    for r in got:
        y = media.resample((np.frombuffer(((texts[r["doc_id"]] or "").encode() + b"\xff" * (r["payload_bytes"] - r["n_bytes"])), np.uint8).astype(np.float32) - 128) / 128)
        if len(y) < 20_000:
            assert np.allclose(np.array(r["mel"]).reshape(media.PARTS, media.BANDS), plain_mel(y), atol=2e-3)
    assert media.audio_features(docs.limit(0)).collect() == []
