"""Registered queries: each calls an operator on proxy columns of the driver's tables, next to its SQL."""

from varloom.queries import annotations, columns, evidence, graphs, groups, joins, models, scalars, scans  # noqa: F401
from varloom.queries.base import ORACLE, QUERIES  # noqa: F401
