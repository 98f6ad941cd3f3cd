"""Signal filters and peak finding in numpy, for use inside grouped functions.

Butterworth designs by the bilinear transform as second-order sections, run forwards
and backwards over an odd extension from steady-state initial conditions (zero phase),
and peaks by local maxima with a distance and a prominence rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class EdaParams:
    """Low-pass of the tonic part and the rule for phasic events."""

    cutoff_hz: float = 0.05
    order: int = 2
    prominence: float = 0.01
    distance_s: float = 1.0


@dataclass(frozen=True)
class BvpParams:
    """Band-pass of the pulse signal and the rule for beats."""

    low_hz: float = 0.5
    high_hz: float = 8.0
    order: int = 3
    prominence_scale: float = 0.2
    distance_s: float = 0.33


MAD_SCALE = 1.4826


@lru_cache(maxsize=64)
def butterworth(order: int, cutoff: float | tuple[float, float], rate_hz: float) -> np.ndarray:
    """Second-order sections (rows b0 b1 b2 1 a1 a2); low-pass for a number, band-pass for a pair."""
    k = np.arange(1, order + 1)
    prototype = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda f: 2 * rate_hz * np.tan(np.pi * f / rate_hz)
    if isinstance(cutoff, tuple):
        low, high = warp(cutoff[0]), warp(cutoff[1])
        centre, width = np.sqrt(low * high), high - low
        half = prototype * width / 2
        root = np.sqrt(half**2 - centre**2)
        analog = np.concatenate([half + root, half - root])
        zeros = np.concatenate([np.ones(order), -np.ones(order)])
        at = np.exp(2j * np.arctan(centre / (2 * rate_hz)))
    else:
        analog = prototype * warp(cutoff)
        zeros = -np.ones(order)
        at = 1.0 + 0j
    poles = (2 * rate_hz + analog) / (2 * rate_hz - analog)
    sections = _sections(zeros, poles)
    response = np.prod([np.polyval(s[:3], at) / np.polyval(s[3:], at) for s in sections])
    sections[0, :3] /= abs(response)
    return sections


def _sections(zeros: np.ndarray, poles: np.ndarray) -> np.ndarray:
    upper = sorted((p for p in poles if p.imag > 1e-12), key=lambda p: (abs(p), p.imag))
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-12), key=abs)
    plus, minus = list(zeros[zeros > 0]), list(zeros[zeros < 0])
    out = []
    for p in upper:
        out.append((_numerator(plus, minus, 2), [1.0, -2 * p.real, abs(p) ** 2]))
    while real:
        pair = [real.pop() for _ in range(min(2, len(real)))]
        denominator = [1.0, -sum(pair), pair[0] * pair[1]] if len(pair) == 2 else [1.0, -pair[0], 0.0]
        out.append((_numerator(plus, minus, len(pair)), denominator))
    return np.array([[*b, *a] for b, a in out])


def _numerator(plus: list[float], minus: list[float], n: int) -> list[float]:
    """Polynomial of up to ``n`` zeros, one from each side where both are left."""
    taken = []
    while len(taken) < n and (plus or minus):
        source = plus if (plus and (not minus or len(plus) >= len(minus))) else minus
        taken.append(source.pop())
    poly = np.poly(taken) if taken else np.array([1.0])
    return [*poly, *[0.0] * (3 - len(poly))]


BLOCK = 128


@lru_cache(maxsize=64)
def _block_response(section: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """What a block's samples give, what the state before it gives, what its samples add to the state, and the state's step over it."""
    b0, b1, b2, _, a1, a2 = section
    step = np.array([[-a1, 1.0], [-a2, 0.0]])  # states without input; the output is the first one
    push = np.array([b1 - a1 * b0, b2 - a2 * b0])  # what a unit of input adds to them
    powers = np.empty((BLOCK + 1, 2, 2))
    powers[0] = np.eye(2)
    for k in range(BLOCK):
        powers[k + 1] = powers[k] @ step
    impulse = np.concatenate([[b0], (powers[: BLOCK - 1] @ push)[:, 0]])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    carried = powers[:BLOCK, 0, :]
    gathered = (powers[:BLOCK][::-1] @ push).T
    return response, carried, gathered, powers[BLOCK]


def _run(section: np.ndarray, x: np.ndarray, start: float) -> np.ndarray:
    """One section from the steady state for a constant ``start``.

    The recursion has two state values (transposed direct form II). Blocks of samples are
    products with the section's impulse response; only the state goes from block to block.
    """
    b0, b1, b2, _, a1, a2 = section
    response, carried, gathered, leap = _block_response(tuple(section.tolist()))
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    z2 = (b2 - a2 * gain) * start
    state = np.array([(b1 - a1 * gain) * start + z2, z2])
    n = len(x)
    blocks = np.concatenate([x, np.zeros(-n % BLOCK)]).reshape(-1, BLOCK)
    added = blocks @ gathered.T
    states = np.empty((len(blocks), 2))
    for k in range(len(blocks)):
        states[k] = state
        state = leap @ state + added[k]
    return (blocks @ response.T + states @ carried.T).ravel()[:n]


def padding(sections: np.ndarray) -> int:
    """Samples of the odd extension at either end."""
    first_order = min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())
    return 3 * int(2 * len(sections) + 1 - first_order)


def filter_both_ways(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering over an odd extension at both ends."""
    pad = padding(sections)
    if len(x) <= pad:
        raise ValueError(f"signal of {len(x)} samples is too short to filter")
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for s in sections:
            y = _run(s, y, y[0])
        y = y[::-1]
    return y[pad:-pad]


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Samples above both neighbours; the middle (to the left) of a plateau counts for it."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.append(edges[1:], len(x))
    values = x[edges]
    top = np.flatnonzero((values[1:-1] > values[:-2]) & (values[1:-1] > values[2:])) + 1
    return (edges[top] + ends[top] - 1) // 2


def _low_since_higher(x: np.ndarray) -> np.ndarray:
    """For every sample, the lowest value back to (not including) the last higher one."""
    out = np.empty(len(x))
    held: list[tuple[float, float]] = []
    for i, v in enumerate(x.tolist()):
        low = v
        while held and held[-1][0] <= v:
            low = min(low, held.pop()[1])
        held.append((v, low))
        out[i] = low
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points before a higher sample on either side."""
    if not len(peaks):
        return np.zeros(0)
    # only where the signal turns can it be highest or lowest
    way = np.sign(np.diff(x))
    turn = np.concatenate([[True], way[1:] != way[:-1], [True]])
    turn[peaks] = True
    turns = np.flatnonzero(turn)
    y, at = x[turns], np.searchsorted(turns, peaks)
    left, right = _low_since_higher(y), _low_since_higher(y[::-1])[::-1]
    return x[peaks] - np.maximum(left[at], right[at])


def find_peaks(x: np.ndarray, distance: float, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Peaks at least ``distance`` samples apart (the highest first) and of ``prominence``; with their prominences."""
    peaks = local_maxima(x)
    apart = max(1, int(np.ceil(distance)))
    keep = np.ones(len(peaks), bool)
    at = peaks.tolist()
    for i in np.argsort(x[peaks], kind="stable")[::-1].tolist() if apart > 1 else ():
        if not keep[i]:
            continue
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(at) and abs(at[j] - at[i]) < apart:
                keep[j] = False
                j += step
    peaks = peaks[keep]
    height = prominences(x, peaks)
    good = height >= prominence
    return peaks[good], height[good]


def decompose_eda(x: np.ndarray, rate_hz: float, params: EdaParams = EdaParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tonic, phasic, event positions, event amplitudes) of a whole recording."""
    if len(x) < 8 * params.order + 1:
        raise ValueError("recording is too short to decompose")
    if not np.isfinite(x).all():
        raise ValueError("recording has non-finite samples")
    tonic = filter_both_ways(butterworth(params.order, params.cutoff_hz, rate_hz), x)
    phasic = x - tonic
    return tonic, phasic, *find_peaks(phasic, params.distance_s * rate_hz, params.prominence)


def detect_beats(x: np.ndarray, rate_hz: float, params: BvpParams = BvpParams()) -> tuple[np.ndarray, np.ndarray]:
    """(beat positions, filtered signal) of a whole recording."""
    if not np.isfinite(x).all():
        raise ValueError("recording has non-finite samples")
    y = filter_both_ways(butterworth(params.order, (params.low_hz, params.high_hz), rate_hz), x)
    scale = MAD_SCALE * float(np.median(np.abs(y - np.median(y))))
    if scale <= 0:
        raise ValueError("signal has no variation")
    return find_peaks(y, params.distance_s * rate_hz, params.prominence_scale * scale)[0], y
