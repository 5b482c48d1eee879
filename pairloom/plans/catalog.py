"""All queries."""

from . import count_queries, graph_queries, lra_queries, model_queries, more_queries, score_queries, spatial_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
