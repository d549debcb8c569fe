"""The registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .bindings import bind, duck

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None) -> Callable:
    """Registers f(*inputs) under name; inputs are names of bindings or tables, sql is over the same names."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*(bind(spark, sf_dir, i) for i in inputs))
        if sql:
            SQL[name] = duck(sql)
        return f

    return add


from . import queries  # noqa: E402,F401  fills the two tables
