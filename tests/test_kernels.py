import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rateloom.functions import codec, kernels, loops, metrics

POINTS = st.lists(st.tuples(st.integers(1, 20), st.integers(0, 30).map(float)), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(st.lists(POINTS, min_size=1, max_size=4), st.integers(1, 60))
def test_choice_is_the_best_of_all(items, budget):
    fits = [(sum(p[1] for p in c), sum(p[0] for p in c)) for c in itertools.product(*items) if sum(p[0] for p in c) <= budget]
    got = kernels.mckp_exact(items, budget)
    if not fits:
        assert got is None
    else:
        assert got[0] == pytest.approx(min(fits)[0])
        assert sum(p[k][0] for p, k in zip(items, got[1])) <= budget


def test_partition_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(40):
        n, budget, most = rng.randint(1, 6), rng.randint(5, 40), rng.choice([None, 1, 2, 3])
        zones = {(a, b): [(rng.randint(1, 15), float(rng.randint(0, 20))) for _ in range(rng.randint(1, 2))] for a in range(n) for b in range(a, n)}
        best = None
        for mask in range(1 << (n - 1)):
            cuts = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
            if most and len(cuts) - 1 > most:
                continue
            for c in itertools.product(*(zones[a, b - 1] for a, b in itertools.pairwise(cuts))):
                if sum(p[0] for p in c) <= budget:
                    best = min(best if best is not None else 1e9, sum(p[1] for p in c))
        got = kernels.partition_exact(n, zones, budget, most)
        assert (got is None) == (best is None) and (got is None or got[0] == pytest.approx(best))


def test_partition_on_a_grid_fits_and_loses_little():
    rng = random.Random(2)
    for _ in range(30):
        n, budget, most = rng.randint(2, 6), rng.randint(300, 900), rng.choice([None, 2])
        zones = {(a, b): [(rng.randint(50, 300), float(rng.randint(0, 20))) for _ in range(2)] for a in range(n) for b in range(a, n)}
        fine, coarse = (kernels.partition_exact(n, zones, budget, most, g) for g in (1, 16))
        if coarse is not None:
            loss, spent, picked = coarse
            assert spent == sum(zones[a, b][k][0] for a, b, k in picked) <= budget and loss >= fine[0]
            assert [a for a, _, _ in picked] == [0] + [b + 1 for _, b, _ in picked[:-1]] and picked[-1][1] == n - 1
            roomy = kernels.partition_exact(n, zones, budget + 16 * n, most, 16)
            assert roomy[0] <= fine[0]


@pytest.mark.parametrize("points,kept", [
    ([(100, 1.0), (200, 0.5), (300, 0.45), (400, 0.1)], [100, 200, 400]), ([(100, 0.5 * 2), (200, 0.5), (300, 0.6)], [100, 200]),
    ([(0, 3.0), (10, 2.0), (20, 1.0)], [0, 20]), ([(100, 1.0), (100, 0.4), (200, 0.1)], [100, 200]),
])
def test_hull_cases(points, kept):
    assert [x for x, _ in kernels.lower_hull(points)] == kept


def test_piecewise_fit_finds_the_corner():
    x = np.arange(41.0)
    y = np.where(x < 15, -2 * x, -30 - 0.1 * (x - 15))
    knots, values = kernels.piecewise_fit(x, y, 3)
    assert knots.tolist() == [0, 15, 40] and np.abs(np.interp(x, knots, values) - y).max() < 1e-6


def test_shared_trajectory_separates_shape_and_offsets():
    rng = np.random.default_rng(2)
    moment, group = np.tile(np.arange(20), 3), np.repeat(np.arange(3), 20)
    shape, offset = rng.normal(size=20), np.array([1.0, -3.0, 2.0])
    got, shift = kernels.shared_trajectory(moment, group, shape[moment] + offset[group], np.ones(60))
    assert np.allclose(shift, offset, atol=1e-5) and np.allclose(got, shape, atol=1e-5)


@pytest.mark.parametrize("method", ["average", "complete", "ward", "kmeans"])
def test_clusters_find_three_huddles(method):
    rng = np.random.default_rng(19)
    x = np.concatenate([rng.normal(c, 0.3, (12, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    label = kernels.kmeans_labels(x, 3) if method == "kmeans" else kernels.linkage_labels(x, 3, method)
    assert len(set(label)) == 3 and all(len(set(label[k : k + 12])) == 1 for k in (0, 12, 24))


def test_layout_keeps_distances():
    x = np.random.default_rng(0).normal(size=(20, 2))
    d = lambda p: np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert np.allclose(d(kernels.classical_scaling(d(x), 2)), d(x))


@pytest.mark.parametrize("n", [100, 101, 150, 64, 33])
def test_resampling_a_tone(n):
    t = np.arange(128) / 128
    back = kernels.resample(kernels.resample(np.sin(2 * np.pi * 5 * t), n), 128)
    assert np.abs(back - np.sin(2 * np.pi * 5 * t)).max() < 1e-9


def test_level_times_carrier_is_the_signal():
    x = np.random.default_rng(1).normal(size=500)
    level, carrier = kernels.decompose(x, np.hanning(33))
    assert np.allclose(level * carrier, x)


def tone(rate=8000, hz=200.0, seconds=1.0):
    t = np.arange(int(rate * seconds)) / rate
    return 0.5 * np.sin(2 * np.pi * hz * t) + 0.1 * np.sin(2 * np.pi * 2 * hz * t)


def test_loop_of_a_tone():
    x = tone()
    assert loops.estimate_period(x, 10, 200) == pytest.approx(40, abs=0.1)
    bounds, lacking = loops.search(x, 8000, 50, 1000)
    assert bounds and not lacking and all((b - a) % 40 in (0, 1, 39) for a, b in bounds)
    assert any(q["rejected"] is None for q in loops.settle(x, bounds))
    assert loops.search(np.zeros(8000), 8000, 50, 1000) == ([], "period")
    long = loops.wrapped(x, *bounds[0], 12000)
    assert len(long) == 12000 and codec.snr(tone(seconds=1.5), long) > 15


def test_codec_trades_bytes_for_distortion():
    x = tone()
    points = [codec.operating_point(x, 8000, codec.Encoding(r, d)) for r, d in ((8000, 16), (8000, 8), (300, 8))]
    assert [p[0] for p in points] == [16000, 8000, 300] and points[0][1] < points[1][1] < 0.05 < points[2][1]
    looped = codec.encode(x, 8000, codec.Encoding(8000, 16, loops.search(x, 8000, 50, 1000)[0][0]))
    assert looped.loop and looped.stored_bytes < 16000 and codec.snr(x, codec.render(looped, 8000, len(x))) > 15
    a, b = (codec.encode(x, 8000, codec.Encoding(8000, 8, dither=True), "same").grid for _ in range(2))
    assert (a == b).all()
    assert codec.content_edge(x, 8000) < 1000 and codec.lowest_rung([8000, 16000, 44100], 9000) == 16000


def test_metric_registry():
    metrics.register_metric("twice", lambda: lambda a, b: a)
    with pytest.raises(ValueError):
        metrics.register_metric("twice", lambda: None)
    assert "twice" in metrics.available_metrics()
    metrics.unregister_metric("twice")
    with pytest.raises(KeyError):
        metrics.build_metric("twice")


def test_bands_add_up_and_filters_hold():
    from rateloom.functions import spectra

    x = np.random.default_rng(4).normal(size=400)
    assert np.abs(spectra.split_bands(x, 8000, [500, 2000]).sum(axis=0) - x).max() < 1e-9
    t = np.arange(8000) / 8000
    kept = spectra.high_pass(np.sin(2 * np.pi * 300 * t) + 2, 8000, 30)
    assert abs(kept.mean()) < 0.01 and abs(np.abs(kept[1000:7000]).max() - 1) < 0.02
    assert spectra.mfcc(x, 8000, 64, 32, 12, 5).shape == (11, 5)
    m = spectra.dct_matrix(8, 8)
    assert np.allclose(m @ m.T, np.eye(8))
    assert spectra.multi_resolution_distance(x, x) == 0 and spectra.cepstral_distortion(x, x, 8000) == 0
    assert spectra.integrated_level_db(np.zeros(100), 8000) is None
    assert spectra.integrated_level_db(np.ones(8000), 8000) == pytest.approx(0)
    profile = spectra.harmonic_profile(tone(), 8000, 200, 3, 512, 256)
    assert (profile[:, 0] > profile[:, 1]).all() and (profile[:, 1] > profile[:, 2]).all()
    step = spectra.one_pole(np.array([0.0, 1, 1, 0, 0]), 0.5, 0.1)
    assert step.tolist() == pytest.approx([0, 0.5, 0.75, 0.675, 0.6075])


def test_velocity_volumes_and_budget():
    from rateloom.operators import notes

    assert notes.velocity_volumes({}, 100) == [0] * 128
    v = notes.velocity_volumes({0: -60.0, 100: -6.0, 127: 0.0}, 100)
    assert v[100] == 64 and v[127] == 64 and v == sorted(v)
    assert notes.split_budget(1000, 100, 50, 2) == 800
    with pytest.raises(ValueError):
        notes.split_budget(100, 100, 50, 2)


def test_piecewise_fit_of_many_readings_needs_no_square_of_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    x = np.arange(3000.0)
    y = np.interp(x, [0, 700, 2000, 2999], [0.0, -30.0, -35.0, -80.0]) + rng.normal(0, 0.5, 3000)
    tracemalloc.start()
    knots, values = kernels.piecewise_fit(x, y, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    assert len(knots) == 4 and np.abs(knots - [0, 700, 2000, 2999]).max() < 20
