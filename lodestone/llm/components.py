"""Connected components by alternating large-star and small-star steps.

Published method (Kiveris et al., 2014). A step is a partially aggregated min
per node and an equi-join, so a hub's rows are split by Spark's skew-join rule;
no component is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import delete_path, materialize, redealt


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, component long), for nodes with an
    edge to another node; component is the smallest node reachable.

    Nulls and self-loops are ignored, repeated edges count once, no edges give an
    empty table.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = materialize(pairs, "edges")
    print_of = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    seen = now.agg(print_of).first()[0]
    if not seen[0]:
        return spark.createDataFrame([], "node bigint, component bigint")
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = redealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(redealt(floor), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(floor.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = materialize(small, "edges")
        delete_path(spark, path)
        now, path = new, new_path
        state = now.agg(print_of).first()[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
