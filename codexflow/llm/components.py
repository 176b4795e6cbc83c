"""Connected components of a link table, in a few joins whose inputs never exceed the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.common import written
from codexflow.session import drop_table, new_table_path, temporary_tables


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Rounds of two star operations: every node hands its larger neighbours to its smallest neighbour, then
    its smaller ones. A hub's links are hooked by a join with one row per node, and minima combine before the
    shuffle. Both are written first: a join of tables, unlike one on top of the aggregation, is split by Spark
    where a hub is hot. Self links and
    repeated links change nothing; an empty table gives an empty one.
    """
    spark = links.sparkSession
    edge = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    path = new_table_path(spark, "llm-links")
    edges = written(links.filter("a <> b").select(*edge(F.col("a"), F.col("b"))).distinct(), "links", path)
    before = None
    for _ in range(rounds):
        after = new_table_path(spark, "llm-stars")
        with temporary_tables(spark):  # a round's tables go when its stars are written
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            lowest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
            large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = written(large, "large-stars")
            low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
                     .select(*edge(F.col("u"), F.col("v"))).distinct())
            edges = written(small, "stars", after)
        drop_table(spark, path)
        path = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.unionByName(roots)
