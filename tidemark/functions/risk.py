"""Return periods: integration weights and expected annual damage."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_weights(periods: list[float]) -> list[float]:
    """Weights w so that sum(w * damage) integrates damage over exceedance frequency.

    Between two neighbouring periods damage is linear in the logarithm of the frequency f = 1 / period; beyond the longest it stays
    constant. The integral over a segment of f - weight of each end - has the antiderivative f ln f - f. Weights are in the order given.
    """
    order = sorted(range(len(periods)), key=lambda i: periods[i])
    f = [1.0 / periods[i] for i in order]
    weights = [0.0] * len(periods)
    for k in range(len(f) - 1):
        (hi, lo), (log_hi, log_lo) = (f[k], f[k + 1]), (math.log(f[k]), math.log(f[k + 1]))
        slope = 1.0 / (log_hi - log_lo)
        area = (hi * log_hi - hi) - (lo * log_lo - lo)
        weights[k] += slope * (area - log_lo * (hi - lo))
        weights[k + 1] += (1.0 + slope * log_lo) * (hi - lo) - slope * area
    weights[-1] += f[-1]
    out = [0.0] * len(periods)
    for place, w in zip(order, weights, strict=True):
        out[place] = w
    return out


def expected_damage(weights: list[float], damages: list[float]) -> float:
    """Expected annual damage of one object."""
    return sum(w * d for w, d in zip(weights, damages, strict=True))


def expected_damage_of(weights: list[float], damages: list[Column]) -> Column:
    """The same for columns, one for each return period; a missing damage counts as none."""
    total = F.lit(0.0)
    for w, d in zip(weights, damages, strict=True):
        total = total + F.lit(w) * F.coalesce(d, F.lit(0.0))
    return total
