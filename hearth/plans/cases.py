"""Queries over tables of cases: each row of a table takes one case by its key, and the SQL knows what the case gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.plans.registry import QUERIES, SQL
from hearth.session import table


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _literal(values: list, kind: str) -> Column:
    """The values as one array literal."""
    return F.array(*[(F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).cast(kind) for v in values])


def by_cases(name: str, inputs: dict[str, str], cases: list[tuple], outputs: list[str], make: Callable[[DataFrame], dict[str, Column]], source: str = "customer", key: str = "c_custkey") -> None:
    """Registers a query: inputs (column -> type) and outputs stand in the cases in this order; make gives the outputs' columns."""
    width = len(inputs)

    def run(spark, sf_dir) -> DataFrame:
        at = (F.col("id") % len(cases)).cast("int")
        rows = table(spark, sf_dir, source).select(F.col(key).alias("id"))
        rows = rows.select("id", *[F.get(_literal([c[i] for c in cases], kind), at).alias(n) for i, (n, kind) in enumerate(inputs.items())])
        return rows.select(*[column.alias(n) for n, column in make(rows).items()])

    lists = ", ".join(f"({_sql([c[width + i] for c in cases])})[{key} % {len(cases)} + 1] AS {n}" for i, n in enumerate(outputs))
    QUERIES[name], SQL[name] = run, f"SELECT {key} AS id, {lists} FROM {source}"
