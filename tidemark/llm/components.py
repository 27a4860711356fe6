"""Connected components by alternating star contractions.

Each round joins every node to the smallest node near it (large star, then
small star); the rounds needed grow with the logarithm of the longest path.
Every step is a hash aggregation with map-side combine and a join whose skewed
side adaptive execution can split; nothing is gathered per node, and lineage is
cut after each round in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _is_star(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the smallest
    node of its component. One aggregation with map-side combine."""
    ends = edges.selectExpr("u as n", "1 as as_u", "0 as as_v").unionAll(edges.selectExpr("v", "0", "1"))
    return not (ends.groupBy("n").agg(F.sum("as_u").alias("us"), F.max("as_v").alias("is_v"))
                .where("us > 1 or us = 1 and is_v = 1").take(1))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node u that is not the smallest of its component, and that
    smallest node v. ``edges`` has columns u and v of a type with an order."""
    now = cut(edges.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    while not _is_star(now):
        near = (now.selectExpr("u as a", "v as b").unionAll(now.selectExpr("v as a", "u as b"))
                .groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m"))
        # larger neighbours u of a node v move to the smallest node near v
        large = now.join(near, F.expr("v = a")).selectExpr("u", "m as v").distinct()
        least = large.groupBy(F.col("u").alias("a")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.expr("u = a"))
        now = cut(joined.where("v <> m").selectExpr("v as u", "m as v")
                  .unionAll(least.selectExpr("a as u", "m as v")).distinct())
    return now
