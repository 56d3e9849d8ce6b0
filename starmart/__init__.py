"""starmart: star-schema marts on Spark.

Public entry points (all lazy DataFrame builders unless noted)::

    from starmart import (MartSpec, Fact, Dimension, Metric, Join, Intent,
                          load_tables, build_dimension, build_fact, star_rollup, answer,
                          check_report, publish_mart)
"""

from starmart.errors import (CheckFailedError, IntentError, NonAdditiveMetricError, SpecError,
                             StarmartError, UnknownTableError)
from starmart.operators.checks import check_report
from starmart.operators.dims import build_all_dimensions, build_dimension
from starmart.operators.facts import build_all_facts, build_fact, build_fact_states
from starmart.operators.star import answer, rollup_fact, rollup_states, star_rollup
from starmart.sinks.publish import current_mart, publish_mart
from starmart.sources.tables import CatalogSource, ParquetSource, load_tables
from starmart.spec import (Dimension, Fact, Intent, Join, MartSpec, Metric, validate_intent,
                           validate_spec)

__all__ = [
    "MartSpec", "Fact", "Dimension", "Metric", "Join", "Intent", "validate_spec", "validate_intent",
    "load_tables", "ParquetSource", "CatalogSource",
    "build_dimension", "build_all_dimensions", "build_fact", "build_all_facts", "build_fact_states",
    "star_rollup", "answer", "rollup_fact", "rollup_states", "check_report", "publish_mart", "current_mart",
    "StarmartError", "SpecError", "UnknownTableError", "IntentError", "NonAdditiveMetricError",
    "CheckFailedError",
]
