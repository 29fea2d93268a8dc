"""Every registered query of the practice operators with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import each, learning, more, practice, stored, streams


def queries() -> dict[str, Callable]:
    return practice.QUERIES | learning.QUERIES | more.QUERIES | each.QUERIES | stored.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return practice.ORACLE_SQL | learning.ORACLE_SQL | more.ORACLE_SQL | each.ORACLE_SQL | stored.ORACLE_SQL | streams.ORACLE_SQL
