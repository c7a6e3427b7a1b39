"""Spectral and posture features of windows, by name: kernels over many windows of one length at once."""

from __future__ import annotations

import numpy as np

#: The feature names of the forests for the four and the six classes.
NAMES = {
    "four": [
        "enmoTrunc", "enmoAbs", "mean", "sd", "coefvariation", "median", "min", "max", "25thp", "75thp", "autocorr", "fmax", "pmax", "fmaxband", "pmaxband", "entropy",
        "fft1", "fft2", "fft3", "fft4", "fft5", "fft6", "fft7", "fft8", "fft9", "fft10", "MAD", "MPD", "skew", "kurt", "f1", "p1", "f2", "p2", "f625", "p625", "totalPower",
    ],
    "six": [
        "enmoTrunc", "enmoAbs", "xMean", "yMean", "zMean", "xRange", "yRange", "zRange", "xStd", "yStd", "zStd", "xyCov", "xzCov", "yzCov", "mean", "sd", "coefvariation", "median", "min", "max",
        "25thp", "75thp", "autocorr", "corrxy", "corrxz", "corryz", "avgroll", "avgpitch", "avgyaw", "sdroll", "sdpitch", "sdyaw", "rollg", "pitchg", "yawg", "fmax", "pmax", "fmaxband", "pmaxband", "entropy",
        "fft1", "fft2", "fft3", "fft4", "fft5", "fft6", "fft7", "fft8", "fft9", "fft10", "MAD", "MPD", "skew", "kurt", "f1", "p1", "f2", "p2", "f625", "p625", "totalPower",
    ],
}
#: Hz between which fmaxband and pmaxband, and f625 and p625, look.
BAND, WALK = (0.3, 3.0), (0.6, 2.5)
#: What `features` makes of a window, in its order.
MADE = ["fmax", "pmax", "fmaxband", "pmaxband", *(f"fft{k}" for k in range(1, 11)), "f625", "p625", "avgroll", "avgpitch", "avgyaw", "sdroll", "sdpitch", "sdyaw", "rollg", "pitchg", "yawg"]


def averaged_power(r: np.ndarray, step_s: float) -> tuple[np.ndarray, np.ndarray]:
    """Hz of the bins above 0, and (windows, bins) the power averaged over sub-windows of a second, at least two samples, that overlap by half; each without its mean, under a raised cosine."""
    n = r.shape[1]
    m = min(n, max(2, round(1 / step_s)))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    if m < 2:
        return np.zeros(0), np.zeros((len(r), 0))
    subs = np.lib.stride_tricks.sliding_window_view(r, m, axis=1)[:, :: max(1, m // 2)]
    power = np.square(np.abs(np.fft.rfft((subs - subs.mean(axis=2, keepdims=True)) * taper, axis=2))).mean(axis=1) / np.square(taper).sum()
    return np.arange(1, m // 2 + 1) / (m * step_s), power[:, 1:]


def strongest(hz: np.ndarray, power: np.ndarray, band: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each window's strongest frequency of a band, ends included, and its power; ties to the lowest, zeros where the band has no bin or no power."""
    inside = np.ones(len(hz), bool) if band is None else (hz >= band[0]) & (hz <= band[1])
    hz, power = hz[inside], power[:, inside]
    if not len(hz):
        return np.zeros(len(power)), np.zeros(len(power))
    at = power.argmax(axis=1)
    top = power[np.arange(len(power)), at]
    return np.where(top > 0, hz[at], 0.0), top


def gravity(v: np.ndarray, step_s: float) -> np.ndarray:
    """(windows, samples, axes): the mean of the samples within half a second either side that the window has."""
    n = v.shape[1]
    half = round(0.5 / step_s)
    run = np.concatenate((np.zeros((len(v), 1, v.shape[2])), v.cumsum(axis=1)), axis=1)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (run[:, hi] - run[:, lo]) / (hi - lo)[:, None]


def angles(v: np.ndarray) -> np.ndarray:
    """(..., roll pitch yaw) of (..., x y z): about x, y and z. What is below a billionth of g is 0."""
    v = np.where(np.abs(v) < 1e-9, 0.0, v)
    x, y, z = v[..., 0], v[..., 1], v[..., 2]
    return np.stack((np.arctan2(y, z), np.arctan2(x, z), np.arctan2(y, x)), axis=-1)


def features(v: np.ndarray, step_s: float) -> np.ndarray:
    """(windows, MADE) of (windows, samples, axes) in g; undefined is 0. fft1 to fft10 are the averaged power of the norm at 1 to 10 Hz (0 beyond half the rate), fmax and pmax its strongest frequency and power, with `band` those of BAND; f625 and p625 are of
    the whole window's spectrum, in WALK. Gravity is taken out of each sample: its mean direction gives rollg, pitchg, yawg, what is left the mean and the sample deviation of roll, pitch and yaw."""
    n, r = v.shape[1], np.sqrt(np.square(v).sum(axis=2))
    hz, power = averaged_power(r, step_s)
    power = np.where(power < 1e-18, 0.0, power)
    whole = np.square(np.abs(np.fft.rfft(r - r.mean(axis=1, keepdims=True), axis=1)))[:, 1:] / n
    own = strongest(np.arange(1, n // 2 + 1) / (n * step_s), np.where(whole < 1e-18, 0.0, whole), WALK)
    by_hz = np.zeros((len(v), 10))
    for k in range(1, 11):
        at = np.flatnonzero(np.abs(hz - k) <= (hz[0] / 2 if len(hz) else 0))
        if len(at):
            by_hz[:, k - 1] = power[:, at[0]]
    down = gravity(v, step_s)
    turn = angles(v - down)
    sd = turn.std(axis=1, ddof=1) if n > 1 else np.zeros((len(v), 3))
    return np.column_stack((*strongest(hz, power), *strongest(hz, power, BAND), by_hz, *own, turn.mean(axis=1), sd, angles(down.mean(axis=1))))
