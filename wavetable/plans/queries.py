"""All registered queries and, where SQL can express them, the same in DuckDB's SQL."""

from wavetable.plans import q_features, q_metrics, q_prep, q_splits, q_studies  # noqa: F401
from wavetable.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
