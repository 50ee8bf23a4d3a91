"""Scalar functions on columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 2) -> Column:
    """Half-up rounding that any SQL engine repeats bit for bit: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def exactly_rounded(x: Column, digits: int = 2) -> Column:
    """Python's round, for results that must agree with it in the last digit. Arrow batches; prefer rounded() in large plans."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or math.isnan(v) else round(v, digits))

    return run(x)


def clean(x: Column) -> Column:
    """NULL for NaN, so that comparisons and sums see no NaN."""
    return F.when(~F.isnan(x), x)


def without_nodata(x: Column, nodata: float | None) -> Column:
    """NULL for the nodata value and for NaN."""
    return clean(x) if nodata is None else F.nullif(clean(x), F.lit(float(nodata)))


def step_decimals(step: float, base: float = 10.0) -> int:
    """Decimals that a step needs: 0.01 -> 2."""
    return abs(math.floor(math.log(step) / math.log(base)))


def depth_bin(depth: Column, decimals: int = 2) -> Column:
    """Integer key of a depth on the lattice of 10^-decimals."""
    return F.floor(depth * float(10**decimals) + 0.5).cast("int")


def clamped(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within [low, high]; NULL stays NULL."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))
