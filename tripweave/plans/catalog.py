"""Loads every query module into the registry."""

from . import (q_basic, q_clean, q_explore, q_features, q_forecast, q_metrics, q_models,  # noqa: F401
               q_spatial, q_stream)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
