"""Columns by name: discovery of exposure columns, output order, header repair and type inference."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns that tell integers and numbers in text columns.
INTEGER = r"^-?[0-9]+$"
NUMBER = r"^-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"


def matching(values, pattern: str) -> list[str]:
    """Values that match the pattern from their start."""
    return [v for v in values if re.match(pattern, v)]


def exposure_columns(columns: list[str], kind: str) -> tuple[list[str], dict[str, dict[str, str]], list[str]]:
    """(suffixes, {"fn": {suffix: column}, "max": ..}, suffixes that miss one of the two) of an exposure type such as `damage`."""
    found: dict[str, dict[str, str]] = {"fn": {}, "max": {}}
    for role, by in found.items():
        for c in columns:
            if m := re.fullmatch(rf"{role}_{re.escape(kind)}(_\w+)?", c):
                by[m[1] or ""] = c
    both = [s for s in found["fn"] if s in found["max"]]
    missing = [s for s in {**found["fn"], **found["max"]} if s not in both]
    return both, {r: {s: by[s] for s in both} for r, by in found.items()}, missing


def output_columns(specific: list[str], types: dict[str, list[str]], bands: list[str] = ("",), extra: list[str] = ()) -> list[str]:
    """Names of the computed columns: for each band the specific ones, each type's components and its total; then the extra ones for each type."""
    out = []
    for band in bands:
        end = f"_{band}" if band else ""
        out += [c + end for c in specific]
        for kind, suffixes in types.items():
            out += [f"{kind}{s}{end}" for s in suffixes] + [f"total_{kind}{end}"]
    return out + [f"{e}_{kind}" for e in extra for kind in types]


def repaired_header(names: list[str] | None, width: int = 0) -> list[str]:
    """Unique, non-empty column names; without a header col_0, col_1, .."""
    if names is None:
        return [f"col_{i}" for i in range(width)]
    named, seen = [n.strip() or f"Unnamed_{i}" for i, n in enumerate(names)], {}
    for n in named:
        seen[n] = seen.get(n, 0) + 1
    count: dict[str, int] = {}
    out = []
    for n in named:
        if seen[n] > 1:
            count[n] = count.get(n, -1) + 1
            n = f"{n}_{count[n]}"
        out.append(n)
    return out


def inferred_types(df: DataFrame) -> dict[str, str]:
    """long, double or string for each text column, over all rows in one pass; an empty cell forces double. Exponents are doubles."""
    tests = []
    for i, c in enumerate(df.columns):
        v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        tests += [F.min(v.rlike(INTEGER)).alias(f"i{i}"), F.min((v == "") | v.rlike(NUMBER)).alias(f"d{i}")]
    r = df.agg(*tests).first()
    return {c: "long" if r[f"i{i}"] else "double" if r[f"d{i}"] else "string" for i, c in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns as their types; empty cells and `nan` become NULL."""
    types = inferred_types(df) if types is None else types
    return df.select([F.nullif(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")), F.lit("nan")).try_cast(types.get(c, "string")).alias(c) for c in df.columns])


def duplicates(values: list) -> list:
    """Values that occur more than once, in order of their first place."""
    return [v for v in dict.fromkeys(values) if values.count(v) > 1]
