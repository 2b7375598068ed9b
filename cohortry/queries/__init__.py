"""Registered queries, one per operator."""

from cohortry.queries import cleaning, elimination, modelling, report_oracle, statistics  # noqa: F401
from cohortry.queries.registry import ORACLES, QUERIES  # noqa: F401
