"""Spectral and posture features against sums in plain loops, and their edges."""

import cmath
import math

import numpy as np
import pytest

from kinelake.operators import score, spectral


def plain(w, step_s):
    """The features of one window (samples, axes), a number at a time."""
    n, r = len(w), [math.sqrt(sum(c * c for c in p)) for p in w]
    m = min(n, max(2, round(1 / step_s)))
    taper = [0.5 - 0.5 * math.cos(2 * math.pi * j / m) for j in range(m)]
    dft = lambda d, k: abs(sum(x * cmath.exp(-2j * math.pi * k * j / len(d)) for j, x in enumerate(d))) ** 2
    starts = range(0, n - m + 1, m // 2)
    power = {}
    for k in range(1, m // 2 + 1):
        each = []
        for s in starts:
            mean = sum(r[s : s + m]) / m
            each.append(dft([(r[s + j] - mean) * taper[j] for j in range(m)], k))
        power[k / (m * step_s)] = sum(each) / len(each) / sum(t * t for t in taper)
    mean = sum(r) / n
    fine = {k / (n * step_s): dft([x - mean for x in r], k) / n for k in range(1, n // 2 + 1)}
    best = lambda p, lo=0, hi=1e9: max(((v, -f) for f, v in p.items() if lo <= f <= hi), default=(0.0, 0.0))
    out = {}
    for name, (v, f) in (("max", best(power)), ("maxband", best(power, *spectral.BAND)), ("625", best(fine, *spectral.WALK))):
        out["f" + name], out["p" + name] = -f, v
    first = min(power)
    for k in range(1, 11):
        out[f"fft{k}"] = next((v for f, v in power.items() if abs(f - k) <= first / 2), 0.0)
    half = round(0.5 / step_s)
    down = [[sum(q[a] for q in w[max(0, i - half) : i + half + 1]) / len(w[max(0, i - half) : i + half + 1]) for a in range(3)] for i in range(n)]
    turn = lambda x, y, z: (math.atan2(y, z), math.atan2(x, z), math.atan2(y, x))
    left = np.array([turn(*(p - g for p, g in zip(q, d, strict=True))) for q, d in zip(w, down, strict=True)])
    for i, c in enumerate(("roll", "pitch", "yaw")):
        out["avg" + c], out["sd" + c], out[c + "g"] = left[:, i].mean(), left[:, i].std(ddof=1), turn(*np.mean(down, axis=0))[i]
    return [out[c] for c in spectral.MADE]


@pytest.mark.parametrize(("n", "step"), [(300, 1 / 30), (21, 0.125), (45, 1 / 30), (7, 1 / 30), (40, 1.0), (33, 0.04)])
def test_features_equal_plain_sums(n, step):
    v = np.random.default_rng(n).normal(0, 0.3, (6, n, 3)) + [0.1, -0.2, 1]
    np.testing.assert_allclose(spectral.features(v, step), [plain(w.tolist(), step) for w in v], rtol=1e-8, atol=1e-10)


def test_a_walk_at_two_hertz():
    t = np.arange(300) / 30
    v = np.stack([0 * t, 0 * t, 1 + 0.3 * np.sin(2 * np.pi * 2 * t)], axis=1)[None]
    got = dict(zip(spectral.MADE, spectral.features(v, 1 / 30)[0], strict=True))
    assert got["fmax"] == got["fmaxband"] == pytest.approx(2) and got["f625"] == pytest.approx(2) and got["pmax"] == got["fft2"] > 10 * got["fft4"]


@pytest.mark.parametrize("n", [1, 2, 3, 30])
def test_still_and_short_windows(n):
    """Nothing moves: no frequency, no power, no angle but gravity's; windows of one sample too."""
    got = dict(zip(spectral.MADE, spectral.features(np.tile([0.0, 0.6, 0.8], (2, n, 1)), 1 / 30)[0], strict=True))
    assert got.pop("rollg") == pytest.approx(math.atan2(0.6, 0.8)) and got.pop("yawg") == pytest.approx(math.pi / 2)
    assert set(got.values()) == {0.0}


def test_every_name_is_made(spark, monkeypatch):
    assert [len(x) for x in spectral.NAMES.values()] == [37, 61] and {*spectral.NAMES["four"], *spectral.NAMES["six"]} <= {*score.FEATURES} and len({*score.FEATURES}) == len(score.FEATURES)
    rng = np.random.default_rng(3)
    rows = [(i, *(rng.normal(0, 1, n).tolist() for _ in "xyz"), "kept") for i, n in enumerate([30, 30, 60, 1, 2, 60, 30])]
    rows += [(7, None, None, None, "kept"), (8, [1.0, None], [1.0, 2.0], [1.0, 2.0], "kept"), (9, [], [], [], "kept")]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>, z array<double>, fft1 string").repartition(1)
    got = {r.id: r for r in score.array_features(df).collect()}
    assert len(got) == 10 and all((got[i][c] is None) == (i > 6) for i in got for c in score.FEATURES)
    monkeypatch.setattr(score, "SAMPLES", 40)
    again = {r.id: r for r in score.array_features(df).collect()}
    for i in range(7):
        np.testing.assert_allclose([again[i][c] for c in score.FEATURES], [got[i][c] for c in score.FEATURES], atol=1e-9)
