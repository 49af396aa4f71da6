"""Defaults of the metrics, resolved on the driver into literals."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    periods_per_year: float = 252.0
    risk_free_rate: float = 0.0
    tol: float = 1e-12


_current = Config()


def get_config() -> Config:
    return _current


def set_config(**changes: float) -> Config:
    global _current
    _current = replace(_current, **changes)
    return _current


@contextmanager
def config(**changes: float) -> Iterator[Config]:
    """Override the defaults inside a ``with`` block."""
    global _current
    before = _current
    try:
        yield set_config(**changes)
    finally:
        _current = before


def ppy_of(value: float | None) -> float:
    return float(get_config().periods_per_year if value is None else value)


def rf_of(value: float | None) -> float:
    return float(get_config().risk_free_rate if value is None else value)
