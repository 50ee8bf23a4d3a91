"""Rules that data and settings must obey. A broken rule raises DataError; softer ones warn."""

from __future__ import annotations

import re
import warnings
from pathlib import Path

from ..errors import DataError
from ..functions.schema import duplicates
from ..operators.overlay import Grid


def entries(keys, mandatory) -> None:
    """Each mandatory entry, a pattern, matches a key."""
    if lost := [m for m in mandatory if not any(re.fullmatch(m, k) for k in keys)]:
        raise DataError(f"missing settings: {', '.join(lost)}")


def grid_entries(config: dict) -> bool:
    """Whether the settings suffice for the grid model."""
    if lost := [k for k in ("hazard.file", "vulnerability.file", "exposure.grid.file") if k not in config]:
        warnings.warn(f"no grid model: {', '.join(lost)} missing", stacklevel=2)
    return not lost


def unique_columns(columns: list[str]) -> None:
    if twice := duplicates(list(columns)):
        raise DataError(f"duplicate columns: {', '.join(twice)}")


def has_srs(srs: str | None, name: str) -> None:
    if not srs:
        raise DataError(f"{name} has no coordinate system")


def global_srs(srs: str | None) -> None:
    if not srs:
        raise DataError("the model has no coordinate system")


def srs_name(authority: str | None, code: str | int | None, proj4: str | None = None) -> str:
    """AUTH:CODE, else the PROJ string."""
    if authority and code:
        return f"{authority}:{code}"
    if not proj4:
        raise DataError("the coordinate system has neither a code nor a definition")
    return proj4


def same_srs(a: str | None, b: str | None) -> bool:
    return bool(a) and a == b


def return_periods(of_bands: list, configured: list | None, name: str = "hazard") -> list[float]:
    """From the bands if all have one, else from the settings if there is one for each band."""

    def numbers(values):
        try:
            return [float(v) for v in values]
        except (TypeError, ValueError):
            return None

    found = numbers(of_bands)
    if found is None and configured is not None and len(configured) == len(of_bands):
        found = numbers(configured)
    if found is None:
        raise DataError(f"{name}: return periods are missing or aren't numbers")
    return found


def band_names(names: list[str], risk: bool, periods: list[float] | None) -> list[str]:
    """5.0y for return periods; one unnamed band for a single event."""
    if risk:
        return [f"{float(p)}y" for p in periods]
    return [""] if len(names) == 1 else list(names)


def extent_within(bounds: tuple[float, float, float, float], grid: Grid) -> bool:
    """Whether objects lie strictly inside the grid; else warns."""
    minx, maxx, miny, maxy = bounds
    x0, x1, y0, y1 = grid.bounds
    ok = x0 < minx and maxx < x1 and y0 < miny and maxy < y1
    if not ok:
        warnings.warn("some objects lie outside the hazard grid", stacklevel=2)
    return ok


def no_subsets(subsets: list[str], path: str) -> None:
    if subsets:
        raise DataError(f"{path} holds several datasets; select one of {', '.join(subsets)}")


def exposure_columns(index: str, columns: list[str], specific: list[str] = ()) -> None:
    if lost := [c for c in (index, *specific) if c not in columns]:
        raise DataError(f"exposure lacks the columns {', '.join(lost)}")


def derived_types(kind: str, found: list[str], missing: list[str]) -> None:
    if not found:
        raise DataError(f"no pair of fn_{kind} and max_{kind} columns")
    if missing:
        warnings.warn(f"{kind}: {', '.join(missing)} has only one of its two columns", stacklevel=2)


def grid_curves(fns: list[str], known: list[str]) -> None:
    if lost := sorted(set(fns) - set(known)):
        raise DataError(f"unknown curves: {', '.join(map(str, lost))}")


def index_column(columns: list[str], index: str) -> None:
    if index not in columns:
        raise DataError(f"the geometry file lacks the index column {index}")


def existing_entries(config, patterns) -> None:
    """Local files that the settings name exist; other stores are left to their readers."""
    for key in config:
        if any(re.fullmatch(p, key) for p in patterns) and "://" not in (path := config.path(key)):
            existing(path)


def existing(path: str | Path, root: str | Path = ".") -> Path:
    """The absolute path; relative ones are taken from root."""
    p = Path(path) if Path(path).is_absolute() else Path(root) / path
    if not p.exists():
        raise FileNotFoundError(p)
    return p.resolve()
