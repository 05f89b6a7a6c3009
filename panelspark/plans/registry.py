"""All registered queries of the library's own operators."""

from . import q_flagship, q_joins, q_models, q_scalars, q_windows
from .testbed import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_flagship", "q_joins", "q_models", "q_scalars", "q_windows"]
