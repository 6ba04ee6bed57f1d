"""Connected components by repeated hooking to the least neighbour, all of it in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for all nodes of the written table `edges` (a, b): root is the least node of the component.

    Alternates two steps until all nodes hang on a root: each node tells its least neighbour to its greater
    ones (large star), then to its smaller ones (small star).  Both keep components and never make more
    edges.  Least neighbours are tables of their own, so that a join on a node of very many neighbours can
    be split.  A self-loop is dropped.  The result stays in the table "least" of `tables`.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below = F.when(F.col("v") < F.col("u"), F.col("v"))
        least = both.groupBy("u").agg(F.min(below).alias("low"), F.max(below).alias("high"), F.max(F.col("v") > F.col("u")).alias("leads"))
        # in a star each node has one smaller neighbour, and no greater ones beside it
        loose = F.col("low").isNotNull() & (F.col("leads") | (F.col("low") != F.col("high")))
        least = tables.write(least.select(F.col("u").alias("node"), F.coalesce("low", "u").alias("root"), loose.alias("loose")), "least")
        if least.where("loose").isEmpty():
            return least.select("node", "root")
        # the least neighbour of v for each greater u
        large = tables.write(pairs.join(least.withColumnRenamed("node", "v"), "v").select("u", F.col("root").alias("v")), "large")
        low = tables.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hooked = F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u"))
        pairs = tables.write(large.join(low, "u").select(hooked.alias("u"), F.col("m").alias("v")).distinct(), "pairs")
