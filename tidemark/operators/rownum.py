"""Exact ``row_number()`` inside groups that may be huge.

``row_number() over (partition by g order by o)`` sends every row of a group
to one task; when one group holds a third of the data (one export, one day)
that task is the job. Here the order key is cut into fixed-width buckets:
rows are numbered inside (g, bucket) — a bounded group — and each bucket gets
the running count of the buckets before it, computed on a per-bucket count
table that is ``2**bucket_bits`` times smaller than the data. Result equals
the plain window exactly (ties in ``o`` are broken arbitrarily in both).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx


def row_number_in_groups(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    out_col: str,
    *,
    bucket_bits: int = 16,
) -> DataFrame:
    """Add ``out_col`` = 1-based position of the row in its group by ``order_col``.

    ``order_col`` must be an integral column; a dense key puts at most
    ``2**bucket_bits`` rows of a group in one task.
    """
    g = ", ".join(sx.ref(c) for c in group_cols)
    order = sx.ref(order_col)
    keyed = df.selectExpr("*", f"shiftright(CAST({order} AS BIGINT), {bucket_bits}) AS _rn_bucket")
    offsets = keyed.groupBy(*group_cols, "_rn_bucket").agg(F.expr("count(1) AS _rn_n")).selectExpr(
        *[sx.ref(c) for c in group_cols], "_rn_bucket",
        f"sum(_rn_n) OVER (PARTITION BY {g} ORDER BY _rn_bucket "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _rn_n AS _rn_off",
    )
    numbered = keyed.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {g}, _rn_bucket ORDER BY {order}) AS _rn_local")
    keep = [sx.ref(c) for c in [*group_cols, *(c for c in df.columns if c not in group_cols)]]
    return numbered.join(offsets, [*group_cols, "_rn_bucket"], "left").selectExpr(
        *keep, f"CAST(_rn_off + _rn_local AS BIGINT) AS {sx.ref(out_col)}")
