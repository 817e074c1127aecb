"""Connected components of a links table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns id and component (the smallest id that can be reached), for the ids of ``links``.

    Null ends and loops are left out. Each round is two grouped minima and two joins whose sides are both
    shuffled; the links of a much-linked id are never brought together. Rounds grow with the logarithm
    of the longest chain, and each is cut as a table in the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut(edges, "links")

    def stars() -> bool:
        """Whether each id has one link upwards, to an id that has none: then all is done."""
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or up = 1 and top = 1").isEmpty()

    while not stars():
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(small.select("u", "m")).distinct(), "links")
    roots = edges.groupBy("v").agg(F.count("*")).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
