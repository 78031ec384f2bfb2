"""Registered queries, each next to the SQL it must agree with."""

from . import (aggregates, alignment, grading, notation, projections, registry, scans,  # noqa: F401
               sequences, signals, stateful, triage)

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
