"""All registered queries."""

from kerbside.plans import function_queries, model_queries, prep_queries, rollup_queries, series_queries, source_queries  # noqa: F401
from kerbside.plans.registry import ORACLES, QUERIES  # noqa: F401
