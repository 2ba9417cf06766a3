"""Composed pipelines and the query registry."""

from . import q_audit, q_calibrate, q_detection, q_evaluate, q_metrics, q_models, q_opinions, q_qualify, q_series, q_sources, q_studies  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
