"""Queries over the shared test tables, one or more per operator."""

from gristmill.queries import (  # noqa: F401
    charting,
    cleaning,
    exploring,
    modelling,
    numbers,
    storage,
)
from gristmill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
