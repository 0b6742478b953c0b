"""Registered queries over the driver's tables, each beside its SQL statement where one exists."""

from lanefold.plans import (  # noqa: F401  (importing registers the queries)
    evaluation_queries,
    noise_queries,
    operations_queries,
    text_queries,
    vector_queries,
)
from lanefold.plans.registry import known, oracles, registered, resolve  # noqa: F401
