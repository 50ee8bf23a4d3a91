"""Hazard types. A type names its mandatory columns and settings, its new columns, and how values of cells become a hazard value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..errors import DataError
from ..operators import hazard


@dataclass(frozen=True)
class HazardType:
    columns: tuple[str, ...]
    entries: tuple[str, ...]
    new_columns: tuple[str, ...]

    def level(self, settings: dict, ground: Column) -> Column:
        raise NotImplementedError

    def of_objects(self, sampled: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
        raise NotImplementedError


class Flood(HazardType):
    def __init__(self):
        super().__init__(("ground_flht", "ground_elevtn"), ("hazard.elevation_reference",), ("inun_depth", "red_fact"))

    def level(self, settings: dict, ground: Column) -> Column:
        return hazard.elevation(str(settings.get("hazard.elevation_reference", "dem")), ground)

    def of_objects(self, sampled: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
        return hazard.object_hazard(sampled, keys, method)


_TYPES: dict[str, HazardType] = {"flood": Flood()}


def register(name: str, kind: HazardType) -> None:
    _TYPES[name] = kind


def hazard_type(name: str = "flood") -> HazardType:
    if name not in _TYPES:
        raise DataError(f"unknown hazard type {name}")
    return _TYPES[name]
