"""Diagnostics against numpy on signals of awkward kinds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateloom.functions import arrays, diagnostics, kernels, scalars, spectra
from rateloom.operators import material, notes

N, RATE = 32, 8000.0


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    signals = [(0, rng.normal(size=N), rng.normal(size=N)), (1, np.zeros(N), np.ones(N)), (2, np.ones(N), np.ones(N))]
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, a, b in signals], "id int, x array<double>, y array<double>")
    x, y = (arrays.dft_magnitude(F.col(c), N) for c in "xy")
    error = arrays.dft_magnitude(arrays.noise(F.col("x"), F.col("y")), N)
    fx, fy = (diagnostics.frame_magnitudes(F.col(c), 16, 8) for c in "xy")
    got = df.select("id", diagnostics.hf_loss_db(x, y, N, RATE, 1000.0).alias("loss"), diagnostics.band_snr(x, error, N, RATE, 500.0, 3000.0).alias("snr"),
                    diagnostics.spread(diagnostics.flux_series(fx)).alias("spread"), diagnostics.log_mel_distance(fx, fy, 16, RATE, 3, 40.0).alias("mel")).collect()
    got = {r["id"]: r for r in got}
    for k, a, b in signals:
        f = np.fft.rfftfreq(N, 1 / RATE)
        above = [(np.abs(np.fft.rfft(s))[(f >= 1000) & (f < RATE / 2)] ** 2).sum() + 1e-12 for s in (a, b)]
        assert got[k]["loss"] == pytest.approx(10 * np.log10(above[0] / above[1]), abs=1e-4)
        held = [kernels.bandlimit(s, RATE, 500.0, 3000.0) for s in (a, b)]
        noise = ((held[0] - held[1]) ** 2).sum()
        if k == 0:
            assert got[k]["snr"] == pytest.approx(10 * np.log10(((held[0] ** 2).sum() + 1e-12) / noise))
        if k == 2:
            assert got[k]["snr"] == math.inf and got[k]["mel"] == 0
        frames = spectra.stft_magnitude(a, 16, 8)
        assert got[k]["spread"] == pytest.approx(np.sqrt((np.diff(frames, axis=0) ** 2).sum(axis=1)).std(), abs=1e-9)
        mels = [spectra.mel_spectrogram(s, RATE, 16, 8, 3) for s in (a, b)]
        floor = max(mels[0].max() * 1e-4, 1e-12)
        want = np.abs(np.log(np.maximum(mels[0], floor)) - np.log(np.maximum(mels[1], floor))).mean()
        assert got[k]["mel"] == pytest.approx(want, abs=1e-6)


def test_one_frame_changes_by_nothing(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert df.select(diagnostics.flux_series(diagnostics.frame_magnitudes(F.col("x"), 16, 8))).first()[0] == [0.0]


def test_sizes_and_coverage(spark):
    one = spark.range(1)
    assert one.select(scalars.resampled_frames(F.lit(5), 2, 1)).first()[0] == 2  # ties to even
    with pytest.raises(ValueError):
        scalars.resampled_frames(F.lit(5), 0, 1)
    assert one.select(scalars.decay_level(F.lit(0.0), F.lit(-20.0), F.lit(1.0), F.lit(2.0))).first()[0] == pytest.approx(0.1)
    routed = spark.createDataFrame([("a", 60), ("a", 60), ("a", 61), ("b", 5), ("b", None), (None, 62)], "i string, k int")
    assert tuple(material.key_coverage(routed, "i", "k", 60, 63).first()) == (4, 3, 0)
    assert tuple(material.key_coverage(routed.limit(0), "i", "k", 60, 63).first()) == (4, 0, 0)
    kept = spark.createDataFrame([(1, 2.0, 3.0), (2, 3.0, 3.0), (3, None, 3.0)], "id int, s double, need double")
    assert [r["id"] for r in notes.shortfalls(kept, "s", "need").collect()] == [1]


def test_shape_of_silence_and_of_equal_signals(spark):
    df = spark.createDataFrame([(0, [0.0] * N, [0.0] * N), (1, [1.0, -2.0] * (N // 2), [1.0, -2.0] * (N // 2)), (2, [0.0] * N, [1.0, -2.0] * (N // 2))],
                               "id int, x array<double>, y array<double>")
    x, y = (diagnostics.frame_magnitudes(F.col(c), 16, 8) for c in "xy")
    got = {r[0]: r[1] for r in df.select("id", diagnostics.spectral_shape(x, y, 16, RATE, 0.85, {"centroid": 0.5, "rolloff": 0.25, "flatness": 0.25, "flux": 0.0})).collect()}
    assert got[0] == got[1] == 0 and got[2] > 1  # relative to nothing
