"""Every registered query; importing this package fills the registry."""

from . import evaluation, folds, parsing, profiling, storage, streams, vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
