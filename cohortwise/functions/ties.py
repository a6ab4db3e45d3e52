"""Sums over the tied deaths of a day in constant work, for Efron's treatment of ties.

With d deaths, risk sum R and tied sum T the l-th death sees the risk set
R - l / d * T, that is T / d * (x - l) with x = d R / T. Sums over l of powers and
logarithms of x - l are differences of the digamma, trigamma and log-gamma functions;
they are taken here by the Euler-Maclaurin formula, after the few smallest terms
have been added one by one. Where T is small against R the
sums are a short power series in T / R with exact power sums of l / d, which also holds for T = 0.
Few deaths are simply added up.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

#: Bernoulli numbers B2, B4, B6, B8.
_BERNOULLI = {2: Fraction(1, 6), 4: Fraction(-1, 30), 6: Fraction(1, 42), 8: Fraction(-1, 30)}
_FEW, _SINGLE, _SMALL, _ORDER = 64, 32, 0.05, 16


def efron_sums(risk: np.ndarray, tied: np.ndarray, deaths: np.ndarray) -> np.ndarray:
    """Six sums a day over l = 0 .. deaths - 1, with f = l / deaths and b = risk - f tied: log b, 1/b, f/b, 1/b^2, f/b^2, f^2/b^2."""
    risk, tied, deaths = (np.asarray(x, float) for x in (risk, tied, deaths))
    out = np.zeros((6, len(risk)))
    few = deaths <= _FEW
    series = ~few & (tied < _SMALL * risk)
    for chosen, method in ((few, _added), (series, _series), (~few & ~series, _differences)):
        if chosen.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                out[:, chosen] = method(risk[chosen], tied[chosen], deaths[chosen])
    return out


def _added(risk: np.ndarray, tied: np.ndarray, deaths: np.ndarray) -> np.ndarray:
    step = np.arange(int(deaths.max(initial=0)))
    here = step < deaths[:, None]
    share = np.where(here, step / deaths[:, None], 0.0)
    base = risk[:, None] - share * tied[:, None]
    one = np.where(here, 1.0 / base, 0.0)
    two = one * one
    return np.stack([np.where(here, np.log(base), 0.0).sum(1), one.sum(1), (share * one).sum(1), two.sum(1), (share * two).sum(1), (share * share * two).sum(1)])


def _power_sum(p: int, deaths: np.ndarray) -> np.ndarray:
    """Sum of (l / deaths) ** p."""
    if p == 0:
        return deaths
    total = deaths / (p + 1) - 0.5
    for j, number in _BERNOULLI.items():
        if j <= p:
            total = total + float(math.comb(p + 1, j) * number / (p + 1)) * deaths ** (1 - j)
    return total


def _series(risk: np.ndarray, tied: np.ndarray, deaths: np.ndarray) -> np.ndarray:
    ratio = tied / risk
    sums = [_power_sum(p, deaths) for p in range(_ORDER + 3)]

    def expanded(k: int, j: int) -> np.ndarray:
        return sum(math.comb(m + j - 1, m) * ratio**m * sums[k + m] for m in range(_ORDER + 1)) / risk**j

    log = deaths * np.log(risk) - sum(ratio**m * sums[m] / m for m in range(1, _ORDER + 1))
    return np.stack([log, expanded(0, 1), expanded(1, 1), expanded(0, 2), expanded(1, 2), expanded(2, 2)])


def _differences(risk: np.ndarray, tied: np.ndarray, deaths: np.ndarray) -> np.ndarray:
    unit = tied / deaths
    least = (risk - tied) / unit + 1.0  # 1 where everybody at risk dies
    top = least + (deaths - 1.0)
    single = least[:, None] + np.arange(_SINGLE)
    low, high = least + (_SINGLE - 0.5), top + 0.5
    p2, p3, p4, p5, p6, p7 = (high**-k - low**-k for k in range(2, 8))
    p1 = (low - high) / (low * high)
    # midpoint rule: integral - g' / 24 + 7 g''' / 5760 - 31 g''''' / 967680, between low and high
    log = high * np.log(high) - low * np.log(low) - (high - low) - p1 / 24 + 7 * 2 * p3 / 5760 - 31 * 24 * p5 / 967680
    one = np.log1p((high - low) / low) + p2 / 24 - 7 * 6 * p4 / 5760 + 31 * 120 * p6 / 967680
    two = -p1 + 2 * p3 / 24 - 7 * 24 * p5 / 5760 + 31 * 720 * p7 / 967680
    log = deaths * np.log(unit) + log + np.log(single).sum(1)
    one = (one + (1.0 / single).sum(1)) / unit
    two = (two + (1.0 / single**2).sum(1)) / unit**2
    shared = (risk * one - deaths) / tied
    return np.stack([log, one, shared, two, (risk * two - one) / tied, (risk * risk * two - 2.0 * risk * one + deaths) / tied**2])
