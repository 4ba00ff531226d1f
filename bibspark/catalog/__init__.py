"""Named queries over the driver tables, each with its SQL equivalent where there is one."""

from bibspark.catalog.registry import ORACLES, QUERIES  # noqa: F401
from bibspark.catalog import (  # noqa: F401
    q_analytics,
    q_clean,
    q_features,
    q_graph,
    q_identity,
    q_metrics,
    q_sources,
)
