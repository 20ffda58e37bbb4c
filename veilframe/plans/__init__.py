"""Queries over the driver's tables."""

from veilframe.plans import queries, workspace  # noqa: F401
