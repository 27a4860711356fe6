"""SQL-text building blocks for fixed expression trees.

A wide projection, a CASE chain or a taxonomy is written as SQL text and
handed to Spark's parser in one call (``F.expr`` / ``selectExpr``). Building
the same tree node by node through the Column API costs one driver-to-JVM
round trip per node, which dominated query set-up time; both forms produce
the same Catalyst expression, so plans and results do not change.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def lit(value) -> str:
    """A SQL literal: strings quoted and escaped, floats typed as DOUBLE."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return f"CAST('{value!r}' AS DOUBLE)"
        return f"{value!r}D"
    s = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def ref(c: str) -> str:
    """A column name as a quoted identifier; any other text is taken as SQL."""
    return f"`{c}`" if _IDENT.fullmatch(c) else c


def str_array(values) -> str:
    """``array(...)`` of string literals (nulls kept as typed nulls)."""
    return "array(" + ", ".join(
        "CAST(NULL AS STRING)" if v is None else lit(v) for v in values) + ")"


def in_list(c: str, values) -> str:
    return f"{ref(c)} IN ({', '.join(lit(v) for v in values)})"


def case_when(pairs, default=None) -> str:
    """``CASE WHEN cond THEN value ... ELSE default END`` from SQL text pairs."""
    body = " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs)
    tail = f" ELSE {default}" if default is not None else ""
    return f"CASE {body}{tail} END"


def expr(sql: str) -> Column:
    return F.expr(sql)
