"""Connected components by alternating large and small stars, with each round's links in the shared store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import drop_folder
from visitflow.session import new_table_path


def _stored(links: DataFrame) -> tuple[DataFrame, str]:
    spark = links.sparkSession
    path = new_table_path(spark, "links")
    links.write.parquet(path)
    return spark.read.schema(links.schema).parquet(path), path


def _state(links: DataFrame) -> tuple:
    return tuple(links.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b`` of one type) that is no root.

    The root is the smallest node of the component. Links of a node to itself, repeated ones and ones
    with a null say nothing. The number of rounds grows with the logarithm of the longest chain. A node
    with very many links is only the key of a pre-aggregated minimum and of a join, whose skewed
    partitions Spark splits; no step collects the links of a node. An empty table gives an empty table.
    """
    spark = links.sparkSession
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links, path = _stored(links)
    state = _state(links)
    while state[0]:
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: the smaller neighbours of a node, and the node, go to the smallest of them.
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .where("b > m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.toDF("a", "b"))
            .distinct()
        )
        following, next_path = _stored(small)
        next_state = _state(following)
        drop_folder(spark, path)
        links, path = following, next_path
        if next_state == state:
            break
        state = next_state
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
