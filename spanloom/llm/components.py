"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of `edges` (``a, b``; bigints): root is the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014).  Each round is two aggregations that
    pre-aggregate before they shuffle and two joins that Spark can split at a hot node; a round's edges are a
    written table, so lineage stays short.  The edge count never grows, and a star needs one round.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        was, mark = mark, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now)
        now = new
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
