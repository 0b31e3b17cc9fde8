"""Registry of the named queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES: dict[str, str] = {}

# Doubles are shown with six decimals. The nudge moves exact halves (means of two microsecond values) off
# the rounding boundary, so that engines that sum in another order still print the same digits.
NUDGE = 1.23e-8


def presented(df: DataFrame) -> DataFrame:
    """Result columns in engine-neutral form: rounded doubles, zone-less timestamps, dates as text."""
    out = []
    for field in df.schema.fields:
        name, kind = f"`{field.name}`", field.dataType.typeName()
        if kind == "double":
            out.append(f"round({name} + {NUDGE}D, 6) AS {name}")
        elif kind in ("timestamp", "date"):
            out.append(f"CAST({name} AS {'TIMESTAMP_NTZ' if kind == 'timestamp' else 'STRING'}) AS {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)


def _rounded(sql: str) -> str:
    """Expand R(expr) to the rounding used by `presented`."""
    out, i = [], 0
    for match in re.finditer(r"\bR\(", sql):
        if match.start() < i:
            raise ValueError("R() cannot be nested")
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[i:match.start()], f"round({NUDGE} + ({sql[match.end():end - 1]}), 6)"]
        i = end
    return "".join(out) + sql[i:]


def with_tables(sql: str) -> str:
    """Prefix a statement with the derived tables it mentions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bt_\w+", text):
            if name in TABLES and name not in order:
                need(TABLES[name])
                if name not in order:
                    order.append(name)

    need(sql)
    head = ",\n".join(f"{name} AS ({TABLES[name]})" for name in order)
    body = sql.strip()
    if head and body.startswith("WITH "):
        return _rounded(f"WITH {head},\n{body[5:]}")
    return _rounded(f"WITH {head}\n{body}" if head else body)


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL twin where one exists."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return presented(fn(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register
