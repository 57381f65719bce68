"""Imports every query module so that the registry is complete."""

from screenlake.plans import q_benchmark, q_documents, q_geometry, q_layout, q_review, q_sources, q_spatial, q_text  # noqa: F401
from screenlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
