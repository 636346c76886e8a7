"""Features of mono PCM: loudness, dynamics, brightness, bass, beat and tempo - numpy over batches in tasks that Spark deals out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Frames, floors and the tempo preference.
FLOOR_DB, AXES_FRAME, AXES_HOP = -60.0, 1024, 512
BASS_HZ, RMS_SECONDS = 200.0, 0.05
BEAT_FRAME, BEAT_HOP, BEAT_SHORTEST, BEAT_LONGEST = 2048, 1024, 0.9, 9.0
TEMPO_FRAME, TEMPO_HOP, TEMPO_CENTRE, TEMPO_WIDTH = 1024, 128, 128.0, 0.9
#: Tracks in an Arrow batch: a track is megabytes of samples.
BATCH = 8


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = 1 + (len(x) - size) // hop
    return np.lib.stride_tricks.as_strided(x, (n, size), (x.strides[0] * hop, x.strides[0])) if n > 0 else np.zeros((0, size))


def _spectra(x: np.ndarray, size: int, hop: int) -> Iterator[np.ndarray]:
    """Magnitudes of frames under a periodic Hann window, some hundred frames at a time, without the outer bins (DC and Nyquist)."""
    frames, window = _frames(x, size, hop), np.hanning(size + 1)[:-1]
    for at in range(0, len(frames), 256):
        yield np.abs(np.fft.rfft(frames[at : at + 256] * window, axis=1))[:, 1:-1]


def _nearest_bin(hz: float, rate: float, size: int) -> int:
    """The bin nearest to ``hz``, within the inner ones."""
    return min(max(int(hz * size / rate + 0.5), 1), size // 2 - 1)


def axes_of(x: np.ndarray, rate: float) -> tuple[float | None, float | None, float | None, float | None]:
    """(loudness dBFS, dynamic range dB, spectral centroid Hz, share of bass); less than a frame gives nulls.

    Centroid and bass leave out DC and Nyquist; silence has zero for both.
    """
    if len(x) < AXES_FRAME:
        return None, None, None, None
    db = lambda p: np.maximum(20 * np.log10(np.maximum(np.sqrt(p), 1e-12)), FLOOR_DB)
    block = max(1, int(rate * RMS_SECONDS + 0.5))
    parts = x[: len(x) // block * block].reshape(-1, block)
    levels = db((parts.astype(np.float64) ** 2).mean(1))
    loud = levels[levels > FLOOR_DB]
    freq, bass = np.arange(1, AXES_FRAME // 2) * rate / AXES_FRAME, _nearest_bin(BASS_HZ, rate, AXES_FRAME)
    total = moment = low = 0.0
    for m in _spectra(x, AXES_FRAME, AXES_HOP):
        total, moment, low = total + m.sum(), moment + (m * freq).sum(), low + m[:, :bass].sum()
    return float(db(np.mean(x.astype(np.float64) ** 2))), float(loud.std()) if len(loud) > 1 else 0.0, float(moment / total) if total > 0 else 0.0, float(low / total) if total > 0 else 0.0


def _flux(x: np.ndarray, size: int, hop: int, power: int, bins: int | None = None) -> np.ndarray:
    """Rise of the spectrum over the frame before, the first over silence: the sum of rises in the lowest ``bins``, or the root of the sum of their squares.

    A single frame has no flux.
    """
    out, before = [np.zeros(0)], np.zeros((1, size // 2 - 1))
    for m in _spectra(x, size, hop):
        rise = np.maximum(np.diff(np.vstack([before, m]), axis=0), 0)[:, :bins]
        out.append(rise.sum(1) if power == 1 else np.sqrt((rise**2).sum(1)))
        before = m[-1:]
    f = np.concatenate(out)
    return f if len(f) > 1 else f[:0]


def _autocorrelation(f: np.ndarray) -> np.ndarray:
    n = len(f)
    spectrum = np.fft.rfft(f, 2 * n)
    return np.fft.irfft(spectrum * np.conj(spectrum))[:n]


def beat_of(x: np.ndarray, rate: float) -> float | None:
    """Highest autocorrelation of the spectral flux at lags of 0.9 to 9 seconds, as a share of its energy; too short gives null, silence zero."""
    f = _flux(x, BEAT_FRAME, BEAT_HOP, 2)
    low, high = max(1, int(BEAT_SHORTEST * rate / BEAT_HOP)), int(BEAT_LONGEST * rate / BEAT_HOP)
    if len(f) <= low + 1 or high <= low:
        return None
    if not np.ptp(f):
        return 0.0
    r = _autocorrelation(f - f.mean())
    return float(np.clip(r[low : min(high, len(f) - 1) + 1].max() / r[0], 0, 1))


def tempo_of(x: np.ndarray, rate: float, least: float = 70.0, most: float = 180.0, band: float | None = None) -> tuple[float | None, float | None]:
    """(bpm, confidence) from the unbiased autocorrelation of the flux; short or silent gives nulls.

    A log-Gaussian around 128 picks the lag; the parabola that refines it and the confidence read the unweighed curve.
    ``band`` leaves out the flux of frequencies above so many Hz.
    """
    f = _flux(np.asarray(x, np.float64), TEMPO_FRAME, TEMPO_HOP, 1, None if band is None else _nearest_bin(band, rate, TEMPO_FRAME))
    per_minute = 60 * rate / TEMPO_HOP
    low, high = max(1, int(np.floor(per_minute / most))), int(np.ceil(per_minute / least))
    if high <= low or len(f) <= high + 1 or not np.ptp(f):
        return None, None
    r = _autocorrelation(f - f.mean())
    raw = np.concatenate([[0.0], r[1 : high + 2] / (len(f) - np.arange(1, high + 2))])
    lags = np.arange(low, high + 1)
    at = int(lags[(raw[lags] * np.exp(-0.5 * (np.log2(per_minute / lags / TEMPO_CENTRE) / TEMPO_WIDTH) ** 2)).argmax()])
    bend = raw[at - 1] - 2 * raw[at] + raw[at + 1]
    shift = 0.5 * (raw[at - 1] - raw[at + 1]) / bend if abs(bend) > 1e-12 else 0.0
    lag = at + float(np.clip(shift, -1, 1))
    return (float(per_minute / lag), float(np.clip(raw[at] / (r[0] / len(f)), 0, 1))) if lag > 0 else (None, None)


FEATURES = "track_id long, rms_loudness_db double, dynamic_range_db double, spectral_brightness_hz double, bass_ratio double, beat_regularity double, bpm double, bpm_confidence double"


def audio_features(pcm: DataFrame, least: float = 70.0, most: float = 180.0, band: float | None = None) -> DataFrame:
    """All features of tracks (track_id, sample_rate, samples: array of float); a null or empty signal gives nulls.

    Deal long recordings out by size before (``repartition``); a batch holds BATCH tracks at most when
    spark.sql.execution.arrow.maxRecordsPerBatch is set so.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                x = np.ascontiguousarray([] if r.samples is None else r.samples, np.float32)
                rows.append((r.track_id, *axes_of(x, r.sample_rate), beat_of(x, r.sample_rate), *tempo_of(x, r.sample_rate, least, most, band)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")]).astype({c.split()[0]: "float64" for c in FEATURES.split(", ")[1:]})

    return pcm.select("track_id", "sample_rate", "samples").mapInPandas(work, FEATURES)


def audio_axes(pcm: DataFrame) -> DataFrame:
    return audio_features(pcm).select("track_id", "rms_loudness_db", "dynamic_range_db", "spectral_brightness_hz", "bass_ratio")


def beat_regularity(pcm: DataFrame) -> DataFrame:
    return audio_features(pcm).select("track_id", "beat_regularity")


def estimate_bpm(pcm: DataFrame, least: float = 70.0, most: float = 180.0, band: float | None = None) -> DataFrame:
    return audio_features(pcm, least, most, band).select("track_id", "bpm", "bpm_confidence")
