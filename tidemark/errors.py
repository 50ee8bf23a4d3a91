"""Errors raised by validation and by the choice of drivers."""


class DataError(ValueError):
    """Input data or settings break a rule."""


class DriverError(ValueError):
    """No reader or writer is known for a file."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"no {kind} driver for {path!r}")
