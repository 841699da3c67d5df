"""Where queries and their SQL are registered, and SQL for the tails of distributions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def select_rounded(*cols: str) -> str:
    """Rounded select items; each is a column or ends with AS and a name."""
    pairs = [(m[1], m[2]) if (m := re.fullmatch(r"(.*) AS (\w+)", c, re.S)) else (c, c) for c in cols]
    return ", ".join(f"round({x}, 6) + 0.0 AS {name}" for x, name in pairs)


def t_p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation ``r`` over ``n`` pairs: the finite series of Student's distribution."""
    c2 = f"(1 - ({r}) * ({r}))"
    odd = f"2 / pi() * (asin(least(1.0, abs({r}))) + abs({r}) * sqrt({c2}) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * power({c2}, k) for k in range(({n} - 3) // 2)]), 0.0))"
    even = f"abs({r}) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * power({c2}, k) for k in range(({n} - 4) // 2 + 1)])"
    return f"greatest(0.0, 1 - CASE WHEN {n} % 2 = 1 THEN {odd} ELSE {even} END)"


def normal_p_sql(z: str) -> str:
    """Two-sided p of a standard normal ``z``: the series of the error function up to 6.5, 0 beyond."""
    x = f"(abs({z}) / sqrt(2.0))"
    terms = f"[CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END * exp((2 * k + 1) * ln({x}) - lgamma(k + 1.0)) / (2 * k + 1) for k in range(90)]"
    return f"CASE WHEN abs({z}) < 1e-300 THEN 1.0 WHEN abs({z}) > 6.5 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum({terms})) END"


def fisher_p_sql(a: str, b: str, c: str, d: str) -> str:
    """Two-sided p of a 2 x 2 table: the hypergeometric weights of all tables that are no likelier."""
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    log = lambda k: f"-(lgamma({k} + 1.0) + lgamma({row} - {k} + 1.0) + lgamma({col} - {k} + 1.0) + lgamma({n} - {row} - {col} + {k} + 1.0))"
    rel = f"[exp({log('k')} - ({log(a)})) for k in range(greatest(0, {row} + {col} - {n}), least({row}, {col}) + 1)]"
    return f"least(1.0, list_sum([x for x in {rel} if x <= 1 + 1e-7]) / list_sum({rel}))"


def bh_sql(p: str, rows: str, by: str = "", key: str = "gene_id") -> str:
    """CTEs hk and hb: ``rows`` with bh, the Benjamini-Hochberg adjustment of ``p`` within ``by``."""
    part = f"PARTITION BY {by} " if by else ""
    return f"""hk AS (SELECT *, rank() OVER ({part}ORDER BY {p}) + count(*) OVER ({part}{',' if by else 'PARTITION BY'} {p}) - 1 AS k_, count({p}) OVER ({part}) AS m_ FROM {rows}),
hb AS (SELECT *, least(1.0, min({p} * m_ / k_) OVER ({part}ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) AS bh FROM hk)"""
