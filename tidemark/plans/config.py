"""Settings: nested TOML as flat dotted keys."""

from __future__ import annotations

import itertools
import re
import tomllib
from pathlib import Path

from ..errors import DataError
from ..functions.scalars import step_decimals
from ..functions.schema import NUMBER


def flattened(nested: dict, parent: str = "") -> dict:
    out = {}
    for k, v in nested.items():
        key = f"{parent}.{k}" if parent else k
        out |= flattened(v, key) if isinstance(v, dict) else {key: v}
    return out


def parsed_value(text: str):
    """A command line value: number, boolean, list in brackets, or text."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [parsed_value(v) for v in text[1:-1].split(",") if v.strip()]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.match(r"^-?[0-9]+$", text):
        return int(text)
    return float(text) if re.match(NUMBER, text) else text


class Config(dict):
    """Flat settings; relative paths are taken from the folder of the settings file."""

    def __init__(self, settings: dict | None = None, root: str | Path = "."):
        super().__init__(flattened(settings or {}))
        self.root = Path(root)

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        path = Path(path)
        with path.open("rb") as f:
            return cls(tomllib.load(f), path.resolve().parent)

    def path(self, key: str) -> str:
        value = str(self[key])
        return value if "://" in value or Path(value).is_absolute() else str(self.root / value)

    def options(self, base: str) -> dict:
        """Settings under a key, by their last part."""
        return {k.rsplit(".", 1)[1]: v for k, v in self.items() if base in k and "." in k}

    def numbered(self, base: str) -> list[str]:
        """Keys base1, base2, .. in order."""
        return sorted((k for k in self if re.fullmatch(re.escape(base) + r"\d+", k)), key=lambda k: int(k[len(base) :]))

    @property
    def output(self) -> str:
        value = str(self.get("output.path", "output"))
        return value if "://" in value or Path(value).is_absolute() else str(self.root / value)


def table_decimals(settings: dict) -> int:
    """Decimals of the lattice of depths: `vulnerability.step_size` if it is set, which must be a power of ten, else `vulnerability.round`."""
    step = settings.get("vulnerability.step_size")
    if step is None:
        return int(settings.get("vulnerability.round", 2))
    decimals = step_decimals(float(step))
    if abs(float(step) * 10**decimals - 1) > 1e-9:
        raise DataError(f"vulnerability.step_size is {step}; steps are 1, 0.1, 0.01 and so on")
    return decimals


def jobs(arguments: dict[str, list], tied: tuple[str, ...] = ()) -> list[dict]:
    """All combinations of the arguments; tied ones go in step."""
    free = [k for k in arguments if k not in tied]
    steps = [dict(zip(tied, v, strict=True)) for v in zip(*(arguments[k] for k in tied), strict=True)] if tied else [{}]
    return [dict(zip(free, v, strict=True)) | s for v in itertools.product(*(arguments[k] for k in free)) for s in steps]
