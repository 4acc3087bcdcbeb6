"""Registered queries: each operator on the given tables, with the equivalent DuckDB SQL where there is one."""

from workload import charts, evaluate, explain, explore, expressions, prepare, profile, sources, train  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
