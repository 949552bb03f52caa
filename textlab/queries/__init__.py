"""Every registered query of the engine with the SQL that states the same result."""

from . import corpora, jobs, reports, scalars, scores  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
