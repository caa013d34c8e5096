"""Numpy helpers for one site's few values: recursions, fits and tests that no column expression gives."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def decayed_sums(x: np.ndarray, alpha: float) -> np.ndarray:
    """y[i] = alpha * y[i - 1] + x[i], by doubling: after each step y[i] holds twice as many terms, so log2(n) array steps."""
    y, step = np.array(x, float), 1
    while step < len(y):
        factor = alpha**step
        if factor == 0:
            break
        y[step:] += factor * y[:-step].copy()
        step *= 2
    return y


def reflected(flow: np.ndarray, pad: int) -> np.ndarray:
    n = len(flow)
    return np.concatenate([flow[1 : pad + 1][::-1], flow, flow[n - pad - 1 : n - 1][::-1]]).astype(float)


def filter_edge(q: np.ndarray, alpha: float) -> tuple[float, float, float]:
    """Of a piece of a series: first and last value, and the quickflow state at its end if it were 0 at its first value."""
    x = (1 + alpha) / 2 * np.diff(q, prepend=q[0])
    return float(q[0]), float(q[-1]), float(decayed_sums(x, alpha)[-1])


def filter_carry(first: np.ndarray, last: np.ndarray, end: np.ndarray, length: np.ndarray, alpha: float) -> np.ndarray:
    """The state at the first value of each of consecutive pieces. A piece takes a state s to alpha**(length - 1) * s + end."""
    out = np.empty(len(first))
    out[0] = first[0]
    for i in range(1, len(first)):
        before = alpha ** float(length[i - 1] - 1) * out[i - 1] + end[i - 1]
        out[i] = alpha * before + (1 + alpha) / 2 * (first[i] - last[i - 1])
    return out


def filter_piece(q: np.ndarray, state: float, alpha: float) -> np.ndarray:
    """A piece's values without quickflow, where that is positive; state: the quickflow at its first value."""
    x = (1 + alpha) / 2 * np.diff(q, prepend=q[0])
    x[0] = state
    quick = decayed_sums(x, alpha)
    return np.where(quick > 0, q - quick, q)


def lyne_hollick(flow: np.ndarray, alpha: float = 0.925, passes: int = 3, reflect: int = 30) -> np.ndarray:
    """Baseflow by the recursive digital filter in alternating directions, ends padded by reflection (Ladson 2013).

    The quickflow state is not clamped inside a pass; each pass filters the baseflow of the one before.
    """
    pad = min(reflect, len(flow) - 1)
    base = reflected(flow, pad)
    for turn in range(passes):
        q = base if turn % 2 == 0 else base[::-1]
        q = filter_piece(q, q[0], alpha)
        base = q if turn % 2 == 0 else q[::-1]
    return base[pad : pad + len(flow)]


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution function, by bisection on erfc."""
    low, high = np.full(np.shape(p), -9.0), np.full(np.shape(p), 9.0)
    erfc = np.vectorize(math.erfc)
    for _ in range(60):
        mid = (low + high) / 2
        below = 0.5 * erfc(-mid / math.sqrt(2)) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def gamma_cdf(x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    """Regularised lower incomplete gamma function, by its power series or continued fraction."""
    out = np.zeros(len(x))
    for i, value in enumerate(np.asarray(x, float) / scale):
        if value <= 0:
            continue
        front = math.exp(-value + shape * math.log(value) - math.lgamma(shape))
        if value < shape + 1:
            term = total = 1 / shape
            k = shape
            while abs(term) > abs(total) * 1e-14:
                k += 1
                term *= value / k
                total += term
            out[i] = total * front
        else:
            b = value + 1 - shape
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 500):
                a = -k * (k - shape)
                b += 2
                d = a * d + b
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = b + a / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-14:
                    break
            out[i] = 1 - front * h
    return np.clip(out, 0, 1)


def standardise_gamma(x: np.ndarray) -> np.ndarray:
    """Standardised precipitation (McKee 1993): gamma by Thom's estimate, a share of zeros apart. NaN if it can't be fitted."""
    x = np.asarray(x, float)
    pos = x[x > 0]
    if len(pos) < 3 or np.ptp(pos) == 0:
        return np.full(len(x), np.nan)
    a = math.log(pos.mean()) - np.log(pos).mean()
    shape = (1 + math.sqrt(1 + 4 * a / 3)) / (4 * a)
    zero = 1 - len(pos) / len(x)
    p = zero + (1 - zero) * gamma_cdf(x, shape, pos.mean() / shape)
    return normal_quantile(np.clip(np.where(x > 0, p, zero / 2), 1e-6, 1 - 1e-6))


def standardise_loglogistic(x: np.ndarray) -> np.ndarray:
    """Standardised precipitation minus evaporation (Vicente-Serrano 2010): log-logistic by probability-weighted moments."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return np.full(n, np.nan)
    s = np.sort(x)
    f = (np.arange(1, n + 1) - 0.35) / n
    w = [float((s * (1 - f) ** k).mean()) for k in range(3)]
    denominator = 6 * w[1] - w[0] - 6 * w[2]
    beta = (2 * w[1] - w[0]) / denominator if denominator else float("nan")
    if not math.isfinite(beta) or abs(beta) <= 1:
        return np.full(n, np.nan)
    gamma = math.gamma(1 + 1 / beta) * math.gamma(1 - 1 / beta)
    alpha = (w[0] - 2 * w[1]) * beta / gamma
    lower = w[0] - alpha * gamma
    with np.errstate(all="ignore"):
        p = 1 / (1 + (alpha / (x - lower)) ** beta)
    return normal_quantile(np.clip(np.where(np.isfinite(p), p, np.where(x <= lower, 0.0, 1.0)), 1e-6, 1 - 1e-6))


def gumbel_mle(x: np.ndarray) -> tuple[float, float]:
    """Location and scale of greatest likelihood, by Newton steps on the scale, safeguarded."""
    x = np.asarray(x, float)
    scale = max(float(x.std(ddof=1)) * math.sqrt(6) / math.pi, 1e-9)
    low = x.min()
    for _ in range(200):
        w = np.exp(-(x - low) / scale)
        mean = (x * w).sum() / w.sum()
        f = x.mean() - mean - scale
        slope = -(((x - mean) ** 2 * w).sum() / w.sum()) / scale**2 - 1
        new = scale - f / slope
        new = new if new > 0 else scale / 2
        if abs(new - scale) < 1e-12 * scale:
            break
        scale = new
    return float(low - scale * math.log(np.exp(-(x - low) / scale).mean())), float(scale)


def gev_lmoments(x: np.ndarray) -> tuple[float, float, float]:
    """Location, scale and shape (positive: heavy tail) of a GEV by L-moments (Hosking 1985)."""
    s, n = np.sort(np.asarray(x, float)), len(x)
    i = np.arange(1, n + 1)
    b0, b1, b2 = s.mean(), (s * (i - 1)).sum() / (n * (n - 1)), (s * (i - 1) * (i - 2)).sum() / (n * (n - 1) * (n - 2))
    l2, t3 = 2 * b1 - b0, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0)
    c = 2 / (3 + t3) - math.log(2) / math.log(3)
    k = 7.8590 * c + 2.9554 * c * c
    if abs(k) < 1e-6:
        scale = l2 / math.log(2)
        return b0 - 0.5772156649015329 * scale, scale, 0.0
    g = math.gamma(1 + k)
    scale = l2 * k / ((1 - 2**-k) * g)
    return b0 - scale * (1 - g) / k, scale, -k


def return_levels(x: np.ndarray, periods: np.ndarray, dist: str = "gumbel") -> np.ndarray:
    """Levels exceeded once in `periods` years on average; NaN for too few or constant values."""
    x = np.asarray(x, float)
    if len(x) < 5 or np.ptp(x) == 0:
        return np.full(len(periods), np.nan)
    y = -np.log(-np.log(1 - 1 / np.asarray(periods, float)))
    if dist == "gumbel":
        loc, scale = gumbel_mle(x)
        return loc + scale * y
    if dist == "gev":
        loc, scale, shape = gev_lmoments(x)
        return loc + scale * (y if shape == 0 else (np.exp(shape * y) - 1) / shape)
    if dist == "lp3":
        return log_pearson_levels(x[None, :], periods)[0]
    raise ValueError(f"unknown distribution {dist}")


def log_pearson_levels(samples: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Log-Pearson III levels by moments of logarithms, a row a sample; NaN for too few, constant or not positive values."""
    x = np.asarray(samples, float)
    n = x.shape[1]
    out = np.full((len(x), len(periods)), np.nan)
    good = (np.ptp(x, axis=1) != 0) & (x > 0).all(axis=1) if n >= 5 else np.zeros(len(x), bool)
    if not good.any():
        return out
    logs = np.log10(x[good])
    m, s = logs.mean(axis=1), logs.std(axis=1, ddof=1)
    skew = (n * ((logs - m[:, None]) ** 3).sum(axis=1) / ((n - 1) * (n - 2) * s**3))[:, None]
    z = log_pearson_z(tuple(np.asarray(periods, float).tolist()))
    with np.errstate(all="ignore"):
        k = np.where(np.abs(skew) < 1e-9, z, 2 / skew * ((np.maximum((z - skew / 6) * skew / 6 + 1, 0)) ** 3 - 1))
    out[good] = 10 ** (m[:, None] + k * s[:, None])
    return out


@lru_cache(maxsize=64)
def log_pearson_z(periods: tuple[float, ...]) -> np.ndarray:
    return normal_quantile(1 - 1 / np.array(periods))


def mann_kendall_p(s: int, n: int, ties: list[int]) -> float:
    """Two-sided p of the statistic S: exact without ties up to 40 values, else normal with tie and continuity corrections."""
    if n < 2:
        return float("nan")
    if not ties and n <= 40:
        counts = [1]
        for m in range(2, n + 1):  # orderings by number of inversions
            new = [0] * (len(counts) + m - 1)
            for i, c in enumerate(counts):
                for j in range(m):
                    new[i + j] += c
            counts = new
        most = n * (n - 1) // 2
        d = (most - abs(s)) // 2
        return min(1.0, 2 * sum(counts[: d + 1]) / math.factorial(n))
    var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    if var <= 0:
        return 1.0
    z = 0 if s == 0 else (s - math.copysign(1, s)) / math.sqrt(var)
    return math.erfc(abs(z) / math.sqrt(2))


def bootstrap_interval(x: np.ndarray, statistic, method: str, block: int | None, resamples: int, level: float, seed: int) -> tuple[float, float, float]:
    """Estimate and percentile interval; `block` method moves blocks of max(5, cube root of n) values."""
    x = np.asarray(x, float)
    n, rng = len(x), np.random.default_rng(seed)
    out = np.empty(resamples)
    size = block or max(5, round(n ** (1 / 3)))
    step = max(1, 2_000_000 // max(n, 1))
    for at in range(0, resamples, step):
        m = min(step, resamples - at)
        if method == "iid":
            index = rng.integers(0, n, (m, n))
        else:
            starts = rng.integers(0, max(n - size, 0) + 1, (m, -(-n // size)))
            index = np.minimum(starts[:, :, None] + np.arange(size), n - 1).reshape(m, -1)[:, :n]
        out[at : at + m] = statistic(x[index], axis=1)
    tail = (1 - level) / 2
    return float(statistic(x[None, :], axis=1)[0]), float(np.quantile(out, tail)), float(np.quantile(out, 1 - tail))
