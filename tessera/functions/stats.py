"""Closed forms of sample sizing, as columns and as plain numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054  # two-sided 95 %
Z_POWER_80 = 0.8416212335729143  # power 80 %


def _z(confidence: float, power: float) -> float:
    a = Z_95 if confidence == 0.95 else NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    b = Z_POWER_80 if power == 0.80 else NormalDist().inv_cdf(power)
    return a + b


def required_queries(sd: float, effect: float, confidence: float = 0.95, power: float = 0.80) -> int:
    """Paired queries that an effect of this size needs; at least 2."""
    if effect <= 0 or sd < 0:
        raise ValueError("the effect must be above 0 and the deviation not below")
    return max(2, math.ceil(_z(confidence, power) ** 2 * sd * sd / (effect * effect)))


def required_queries_column(sd: Column, effect: Column, confidence: float = 0.95, power: float = 0.80) -> Column:
    z = _z(confidence, power)
    return F.greatest(F.lit(2), F.ceil(F.lit(z * z) * sd * sd / (effect * effect))).cast("long")


def detectable_effect(sd: Column, n: Column, confidence: float = 0.95, power: float = 0.80) -> Column:
    """The smallest effect that n paired queries can tell from none."""
    return F.lit(_z(confidence, power)) * sd / F.sqrt(n)
