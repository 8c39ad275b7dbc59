"""Query registry: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. Oracle SQL runs on DuckDB views of the same parquet files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _matching_paren(s: str, start: int) -> int:
    """Index of the parenthesis closing the one at ``start`` (quotes respected)."""
    depth, i, quote = 0, start, None
    while i < len(s):
        c = s[i]
        if quote:
            if c == quote:
                quote = None
        elif c in ("'", '"'):
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise ValueError("unbalanced parentheses in oracle SQL")


def _split_last_arg(body: str) -> tuple[str, str]:
    depth, quote = 0, None
    for i in range(len(body) - 1, -1, -1):
        c = body[i]
        if quote:
            if c == quote:
                quote = None
        elif c in ("'", '"'):
            quote = c
        elif c == ")":
            depth += 1
        elif c == "(":
            depth -= 1
        elif c == "," and depth == 0:
            return body[:i], body[i + 1:]
    return body, ""


def spark_rounding(sql: str) -> str:
    """Rewrite ``round(x, d)`` so DuckDB rounds like Spark: half-up on the
    shortest decimal form of the double (DuckDB rounds the binary value, which
    differs on exact ties such as 333/640 = 0.5203125). String literals are
    left untouched."""
    out, i, start, quote = [], 0, 0, None
    n = len(sql)
    while i < n:
        c = sql[i]
        if quote:
            if c == quote:
                quote = None
            i += 1
            continue
        if c in ("'", '"'):
            quote = c
            i += 1
            continue
        if (sql[i:i + 6].lower() == "round(" and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_"))):
            k = _matching_paren(sql, i + 5)
            x, d = _split_last_arg(sql[i + 6:k])
            if d.strip().isdigit():
                out.append(sql[start:i])
                out.append(f"CAST(round(CAST(CAST(CAST({spark_rounding(x)} AS DOUBLE) AS VARCHAR) "
                           f"AS DECIMAL(38, 18)), {d.strip()}) AS DOUBLE)")
                i = start = k + 1
                continue
        i += 1
    out.append(sql[start:])
    return "".join(out)


PRELUDE: dict[str, str] = {}


def with_prelude(sql: str) -> str:
    """``sql`` behind the definitions of the named tables that it, or one of them, reads (in order of definition)."""
    text, used = sql, []
    for name in reversed(PRELUDE):
        if re.search(rf"\b{name}\b", text):
            used.insert(0, name)
            text += PRELUDE[name]
    if not used:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PRELUDE[n]})" for n in used) + f"\nSELECT * FROM ({sql})"


def register(name: str, sql: str | None = None):
    """Decorator: register a query builder (and its oracle SQL, if SQL-expressible)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries, then finish their SQL."""
    global _finished
    from textlab.plans import (  # noqa: F401
        q_cleaning, q_profile, q_tokens, q_log, q_augment, q_scoring, q_io,
    )
    if not _finished:
        _finished = True
        for name, sql in ORACLE.items():
            ORACLE[name] = spark_rounding(with_prelude(sql))


_finished = False
