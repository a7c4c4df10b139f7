"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """node, root: every node that has a link, with the smallest node that it reaches.

    Large-star and small-star steps in turn: each joins neighbours to the smallest one known, so edges
    never multiply, the number of rounds is logarithmic, and no node's neighbours are gathered in one
    place.  Each round is stored; nothing but two sums comes to the driver.

    Defined cases: links with a null end are left out; a link to itself, repeated links and links in both
    directions change nothing; columns after the first two are ignored; no links give no rows."""
    a, b = links.columns[:2]
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct()
    cur, was = common.stored(pairs), None
    while True:
        both = cur.unionByName(cur.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("least")).select(F.col("v").alias("u"), F.least("v", "least").alias("least"))
        large = both.where("m > v").join(least, F.col("v") == F.col("u")).select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low")).withColumnRenamed("v", "u")
        near = large.join(low, F.col("v") == F.col("u")).select("v", "m", "low")
        small = near.select("v", F.col("low").alias("m")).unionByName(near.select(F.col("m").alias("v"), F.col("low").alias("m"))).where("v <> m").distinct()
        cur = common.stored(small)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    roots = cur.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return common.stored(roots.unionByName(cur.select(F.col("m").alias("node"), F.col("m").alias("root"))).distinct())
