"""All registered queries; importing this module fills the registry."""

from . import (  # noqa: F401
    queries_features,
    queries_ingest,
    queries_quality,
    queries_news,
    queries_scoring,
    queries_joins,
    queries_evaluation,
    queries_ranking,
    queries_modeling,
    queries_streaming,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
