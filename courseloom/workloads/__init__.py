"""Queries over the driver tables, one per operator, with their SQL."""

from courseloom.workloads import builds, cells, landed, outputs, relational, resolution, rules, schedule, search, state, texts  # noqa: F401
from courseloom.workloads.registry import QUERIES, SQL  # noqa: F401
