"""Signal kernels over batches of equal-length rows (rows by time), and their Arrow functions.

Filters are Butterworth second-order sections by the bilinear transform, run forward and backward; the loop over time
handles all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def butterworth(order: int, cut: float | tuple[float, float], fs: float, kind: str) -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) of a low, high or stop filter."""
    edges = np.atleast_1d(np.asarray(cut, float))
    if (edges <= 0).any() or (edges >= fs / 2).any():
        raise ValueError(f"{cut} Hz is not between 0 and {fs / 2} Hz")
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "low":
        poles, zeros = poles * warped[0], np.empty(0)
    elif kind == "high":
        poles, zeros = warped[0] / poles, np.zeros(order)
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = width / 2 / poles
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros = np.concatenate([half + root, half - root]), np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)])
    p = (2 * fs + poles) / (2 * fs - poles)
    z = np.concatenate([(2 * fs + zeros) / (2 * fs - zeros), np.full(len(poles) - len(zeros), -1.0)])
    # conjugate pairs make sections; real ones are paired with each other
    sections = []
    for roots in (p, z):
        upper = sorted((r for r in roots if r.imag > 1e-12), key=lambda r: abs(r))
        real = sorted(r.real for r in roots if abs(r.imag) <= 1e-12)
        polys = [np.array([1, -2 * r.real, abs(r) ** 2]) for r in upper]
        polys += [np.poly(real[i : i + 2]) for i in range(0, len(real), 2)]
        sections.append([np.pad(q, (0, 3 - len(q))) for q in polys])
    out = np.array([np.concatenate([b, a]) for b, a in zip(sections[1], sections[0], strict=True)])
    at = -1.0 if kind == "high" else 1.0  # unit gain where the filter passes fully
    powers = at ** -np.arange(3)
    for s in out:
        s[:3] /= (s[:3] @ powers) / (s[3:] @ powers)
    return out


def settled(sos: np.ndarray) -> np.ndarray:
    """State of each section after a long constant input of 1."""
    states, gain = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        states[i] = gain * np.array([y - b0, b2 - a2 * y])
        gain *= y
    return states


def run_from(sos: np.ndarray, x: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output of the sections, and their states after it, in extended precision: with poles near 1 a double's rounding adds up. states: rows, sections, 2."""
    x, states = x.astype(np.longdouble), states.astype(np.longdouble)
    after = np.empty_like(states)
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s0, s1 = states[:, i, 0], states[:, i, 1]
        out = np.empty_like(x)
        for t in range(x.shape[1]):
            u = x[:, t]
            y = b0 * u + s0
            s0, s1 = b1 * u - a1 * y + s1, b2 * u - a2 * y
            out[:, t] = y
        after[:, i, 0], after[:, i, 1], x = s0, s1, out
    return x, after


def run_plain(sos: np.ndarray, x: list[float], state: list[float]) -> list[float]:
    """run_from for one row in doubles, as a loop over all samples has them to the bit. state, flat, becomes that after x."""
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        s0, s1 = state[2 * i : 2 * i + 2]
        out = []
        for u in x:
            y = b0 * u + s0
            s0, s1 = b1 * u - a1 * y + s1, b2 * u - a2 * y
            out.append(y)
        state[2 * i : 2 * i + 2] = s0, s1
        x = out
    return x


def _run(sos: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return run_from(sos, x, settled(sos) * first[:, None, None])[0]


def step_matrix(sos: np.ndarray) -> np.ndarray:
    """What one sample of silence makes of the states, flat."""
    m = 2 * len(sos)
    return run_from(sos, np.zeros((m, 1)), np.eye(m).reshape(m, len(sos), 2))[1].reshape(m, m).T


def edge_of(sos: np.ndarray) -> int:
    """Samples by which a signal is extended at both ends."""
    return 3 * int(2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension at both ends."""
    edge = edge_of(sos)
    if x.shape[1] <= edge:
        raise ValueError(f"{x.shape[1]} samples are too few to filter; more than {edge} are needed")
    wide = np.concatenate([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]], axis=1)
    wide = _run(sos, wide, wide[:, 0])
    back = wide[:, ::-1]
    return _run(sos, back, back[:, 0])[:, ::-1][:, edge:-edge].astype(float)


def lowpass(x: np.ndarray, fs: float, cut: float, order: int = 4) -> np.ndarray:
    return zero_phase(butterworth(order, cut, fs, "low"), x)


def highpass(x: np.ndarray, fs: float, cut: float, order: int = 2) -> np.ndarray:
    return zero_phase(butterworth(order, cut, fs, "high"), x)


def bandstop(x: np.ndarray, fs: float, band: tuple[float, float], order: int = 4) -> np.ndarray:
    return zero_phase(butterworth(order, band, fs, "stop"), x)


def preprocess(x: np.ndarray, fs: float, target: float, cut: float = 0.1) -> np.ndarray:
    """Anti-alias low-pass at the target's Nyquist rate, decimation by a whole factor, high-pass; volts to microvolts."""
    step = round(fs / target)
    if step > 1:
        x = lowpass(x, fs, target / 2)[:, ::step]
    return highpass(x, fs / step, cut) * 1e6


def welch(x: np.ndarray, fs: float, width: int | None = None, window: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided densities): half-overlapping segments, each without its mean."""
    n = x.shape[1]
    width = min(n, width or round(fs))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width) if window == "hann" else np.ones(width)
    step = width - width // 2
    total, starts = 0.0, range(0, n - width + 1, step)
    for a in starts:
        seg = x[:, a : a + width]
        total = total + np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * w)) ** 2
    psd = total / len(starts) / (fs * (w * w).sum())
    psd[:, 1 : None if width % 2 else -1] *= 2
    return np.fft.rfftfreq(width, 1 / fs), psd


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """n samples over the same time, by cutting or padding the spectrum."""
    m = x.shape[1]
    if n == m:
        return x
    spectrum, low = np.fft.rfft(x), min(n, m)
    out = np.zeros((len(x), n // 2 + 1), complex)
    out[:, : low // 2 + 1] = spectrum[:, : low // 2 + 1]
    if low % 2 == 0:
        out[:, low // 2] *= 2 if n < m else 0.5
    return np.fft.irfft(out, n) * n / m


def zscored(x: np.ndarray, eps: float) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + eps)


def model_input(x: np.ndarray, fs: float, target: float = 16000.0, cut: float | None = None) -> np.ndarray:
    x = lowpass(x, fs, cut) if cut else x
    return zscored(resample(x, round(x.shape[1] * target / fs)), 1e-10).astype(np.float32)


def whiten(x: np.ndarray, reference: np.ndarray, fs: float, floor: float = 1e-9) -> np.ndarray:
    """x divided by the root of a reference power spectrum on an even grid up to fs / 2; the power of each row stays."""
    if not (reference > 0).any():
        raise ValueError("the reference has no power")
    grid = np.interp(np.fft.rfftfreq(x.shape[1], 1 / fs), np.linspace(0, fs / 2, len(reference)), reference)
    out = np.fft.irfft(np.fft.rfft(x) / np.sqrt(np.maximum(grid, floor * grid.max())), x.shape[1])
    level = np.sqrt((out * out).mean(axis=1, keepdims=True))
    return out * np.sqrt((x * x).mean(axis=1, keepdims=True)) / np.where(level > 0, level, 1)


def randomise_phase(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Random phases with the magnitudes kept; row i draws from seeds[i], so that results don't depend on batches."""
    spectrum, n = np.fft.rfft(x), x.shape[1]
    phase = np.stack([np.random.default_rng(int(s)).uniform(0, 2 * np.pi, spectrum.shape[1]) for s in seeds]) if len(seeds) else np.empty(spectrum.shape)
    out = np.abs(spectrum) * np.exp(1j * phase)
    out[:, 0] = spectrum[:, 0]
    if n % 2 == 0:
        out[:, -1] = spectrum[:, -1].real
    return np.fft.irfft(out, n)


def by_length(values: pd.Series, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.Series:
    """f over the rows of each length, stacked; f also gets their places. Null rows stay null."""
    out: list = [None] * len(values)
    lengths = values.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        for i, row in zip(at, f(np.stack(values.iloc[at]).astype(float), at)):
            out[i] = row.tolist()
    return pd.Series(out, index=values.index, dtype=object)


def vector_function(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A kernel as a function of an array column."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return by_length(values, lambda x, _: f(x))

    return lambda c: run(c.cast("array<double>"))


def seeded_function(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("array<double>")
    def run(values: pd.Series, seeds: pd.Series) -> pd.Series:
        s = seeds.to_numpy()
        return by_length(values, lambda x, at: f(x, s[at]))

    return lambda c, seed: run(c.cast("array<double>"), seed.cast("long"))


def referenced_function(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A kernel that takes a second vector for each row; rows with equal ones run together."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, references: pd.Series) -> pd.Series:
        keys = references.map(lambda v: np.asarray(v, float).tobytes())
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        for key, own in values.groupby(keys, sort=False):
            ref = np.frombuffer(key)
            for i, row in by_length(own, lambda x, _: f(x, ref)).items():
                out.at[i] = row
        return out

    return lambda c, ref: run(c.cast("array<double>"), ref.cast("array<double>"))
