"""Every registered query, by topic."""

from millrace.plans import (  # noqa: F401
    checks,
    columns,
    joining,
    ordering,
    scripting,
    storage,
    summaries,
    texts,
)
from millrace.plans.registry import ORACLES, QUERIES, Tables, run

__all__ = ["ORACLES", "QUERIES", "Tables", "run"]
