"""Registered queries and, where SQL can say the same, the SQL to check them with."""

from lakegraph.plans import (  # noqa: F401  (each module registers its queries)
    catalog, graph, joins, quality, search, sources, streams, tables, text,
)
from lakegraph.plans import scanned  # noqa: F401  (repeats check SQL of the modules above)
from lakegraph.plans.registry import ORACLES, QUERIES  # noqa: F401
