import numpy as np
import pytest

from quaywave.functions import kernels as k


def gain(sos, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return 20 * np.log10(np.prod([abs((s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z)) for s in sos]) + 1e-300)


def test_filters_meet_their_edges():
    sos = k.butterworth_bandpass(4, 1, 45, 1000)
    assert gain(sos, 1, 1000) == pytest.approx(-3.01, abs=0.02) and gain(sos, 45, 1000) == pytest.approx(-3.01, abs=0.02)
    assert gain(sos, 0.5, 1000) < -15 and abs(gain(sos, 10, 1000)) < 0.1
    hum = k.notch(50, 30, 1000)
    assert gain(hum, 50, 1000) < -60 and abs(gain(hum, 40, 1000)) < 0.1


def test_zero_phase_keeps_a_sine_and_a_short_or_constant_signal_is_defined():
    t = np.arange(4000) / 1000
    y = k.zero_phase(k.butterworth_bandpass(4, 1, 45, 1000), np.sin(2 * np.pi * 10 * t) + 3)
    assert np.abs(y[1500:2500] - np.sin(2 * np.pi * 10 * t)[1500:2500]).max() < 0.05
    for x in (np.ones(5), np.zeros(1), np.full(64, 5.0)):
        assert np.isfinite(k.zero_phase(k.notch(50, 30, 1000), x)).all()


def test_stockwell_finds_the_frequency():
    fs, f = 200.0, np.linspace(2, 40, 39)
    for hz in (8.0, 15.0, 30.0):
        s = k.stockwell(np.sin(2 * np.pi * hz * np.arange(400) / fs)[None], fs, f)[0]
        assert s.shape == (39, 400) and abs(f[s.mean(axis=1).argmax()] - hz) <= 1
    de = k.stockwell_entropy(np.zeros((1, 400)), fs, (("a", 4.0, 8.0), ("none", 90.0, 95.0)), 1, 50)
    assert np.isfinite(de).all() and de[0, 1] == -10


def test_filtered_entropy_ranks_bands_by_their_power():
    t = np.arange(1000) / 250
    bands = (("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0))
    x = (3 * np.sin(2 * np.pi * 10 * t) + 0.1 * np.sin(2 * np.pi * 20 * t))[None]
    for de in (k.filtered_entropy(x, 250, bands)[0], k.stockwell_amplitude_entropy(x + np.random.default_rng(0).normal(0, 0.5, x.shape), 250, bands, 1, 50)[0]):
        assert np.isfinite(de).all()
    assert np.argmax(k.filtered_entropy(x, 250, bands)[0]) == 1


def test_wavelet_filter_is_orthonormal():
    h = k.daubechies(4)
    assert h.sum() == pytest.approx(2**0.5) and (h * h).sum() == pytest.approx(1)
    assert (h[:-2] * h[2:]).sum() == pytest.approx(0, abs=1e-9)
    assert k.wavelet_log_variance(np.random.default_rng(0).normal(size=(3, 64))).shape == (3, 6)


def test_models_separate_what_can_be_separated():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-2, 1, (60, 4)), rng.normal(2, 1, (60, 4))])
    y = np.repeat([-1, 1], 60)
    for fit in (k.lda_fit, k.ridge_fit, k.logistic_fit):
        classes, w, b = fit(x, y)
        assert (classes[np.argmax(x @ w + b, axis=1)] == y).mean() > 0.97
    ring = rng.normal(size=(200, 2))
    inside = (np.linalg.norm(ring, axis=1) < 1.1).astype(int)
    assert (k.svm_decide(k.svm_fit(ring, inside, 10.0, 1.0, degree=2), ring) == inside).mean() > 0.95
    assert (k.svm_decide(k.svm_fit(ring, inside, 10.0, 1.0), ring) == inside).mean() > 0.95


def test_csp_prefers_the_axis_that_differs():
    w = k.csp_filters(np.diag([9.0, 1, 1]), np.diag([1.0, 1, 1]), 1)
    assert np.argmax(np.abs(w[:, 0])) == 0


def test_yeo_johnson_straightens_and_information_tells():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(size=800))
    z = k.yeo_johnson(x, k.yeo_johnson_fit(x))
    skew = lambda v: abs(((v - v.mean()) ** 3).mean() / v.std() ** 3)
    assert skew(z) < 0.2 < skew(x)
    y = rng.integers(0, 2, 400)
    assert k.knn_mutual_information(y + rng.normal(0, 0.1, 400), y) > 0.5 > k.knn_mutual_information(rng.normal(size=400), y) + 0.3


def test_kth_distance_equals_brute_force():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=50), rng.integers(0, 6, 40).astype(float), np.array([1.0, 1.0]), np.zeros(9)):
        for n in (1, 3, len(x) - 1):
            n = min(n, len(x) - 1)
            assert np.allclose(k.kth_distance(x, n), np.sort(np.abs(x[:, None] - x[None, :]), axis=1)[:, n])


def test_automatic_shrinkage():
    rng = np.random.default_rng(4)
    few, many = rng.normal(size=(12, 30)), rng.normal(size=(4000, 5)) * [1, 2, 3, 4, 5]
    one, two = (k.ledoit_wolf(x - x.mean(axis=0)) for x in (few, many))
    assert 0.5 < one <= 1 and two < 0.02 and k.ledoit_wolf(np.zeros((4, 3))) == 0
    x = few - few.mean(axis=0)
    s = x.T @ x / len(x)
    b = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in x]) / len(x)
    assert np.isclose(one, min(1, b / ((s - np.trace(s) / 30 * np.eye(30)) ** 2).sum()))


def test_mirrored_wavelet_ends():
    x = np.random.default_rng(5).normal(size=(2, 37))
    low = k.daubechies(4)
    wide = np.concatenate([x[:, 6::-1], x, x[:, :-8:-1]], axis=1)
    first = np.stack([wide[:, a : a + 8] @ low for a in range(1, wide.shape[1] - 7, 2)], axis=1)
    out = k.wavelet_log_variance(x, level=1)
    assert first.shape[1] == (37 + 7) // 2 and np.allclose(out[:, 0], np.log(first.var(axis=1) + 1e-10))
    assert k.wavelet_log_variance(x, mode="periodic").shape == k.wavelet_log_variance(x).shape == (2, 6)


def test_direct_form_equals_sections_in_the_middle():
    rng = np.random.default_rng(0)
    x, sos = rng.normal(size=(3, 2000)), k.butterworth_bandpass(4, 1, 50, 200)
    b, a = k.polynomials(sos)
    assert len(a) == 9 and abs(a[0] - 1) < 1e-12
    one, two = k.zero_phase_direct(b, a, x), k.zero_phase(sos, x)
    assert np.abs(one - two)[:, 500:-500].max() < 1e-6 and one.shape == x.shape
    flat = np.full((1, 40), 3.0)
    hum = k.polynomials(k.notch(50, 30, 200))
    assert np.allclose(k.zero_phase_direct(*hum, flat), 3.0)


def test_unfinished_support_vectors_warn():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), np.arange(30) % 2

    with pytest.warns(RuntimeWarning, match="not converged"):
        k.svm_fit(x, y, 1e6, tol=-1.0)
