"""Tables written to the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.tables import folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: what reads it survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int) -> None:
    """At most so many rows in an Arrow batch of this session: with long texts the default needs too much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def blocks_for(docs: DataFrame, text: str = "text", block_bytes: int = 24_000_000, least: int = 12) -> int:
    """How many blocks of about ``block_bytes`` of text the table makes: grows with the input, never with a group."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-total // block_bytes))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (u, v); root is the smallest node of its component.

    Every node that is no local minimum hooks to its smallest neighbour, edges are rewritten to what their ends
    hooked to, and loops and repeats are dropped. On ids that are hashes the edges shrink by a constant factor a
    round, so rounds grow with the logarithm. Nothing is collected; each round is a written table. The roots found
    this way need not be smallest; one grouped minimum at the end makes them so.
    """
    order = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    left = written(order, "edges")
    hooked = None
    while not left.isEmpty():
        down = left.select(F.col("v").alias("node"), F.col("u").alias("to"))
        step = written(down.groupBy("node").agg(F.min("to").alias("to")), "hooks")
        one = step.select(F.col("node").alias("u"), F.col("to").alias("u_to"))
        two = step.select(F.col("node").alias("v"), F.col("to").alias("v_to"))
        moved = left.join(one, "u", "left").join(two, "v", "left").select(
            F.coalesce("u_to", "u").alias("a"), F.coalesce("v_to", "v").alias("b")
        )
        left = written(
            moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges"
        )
        if hooked is None:
            hooked = step
        else:
            old = hooked.select("node", F.col("to").alias("via"))
            via = step.select(F.col("node").alias("via"), F.col("to").alias("next"))
            known = old.join(via, "via", "left").select("node", F.coalesce("next", "via").alias("to"))
            new = step.join(hooked.select("node"), "node", "left_anti")
            hooked = written(known.unionByName(new), "hooked")
    if hooked is None:
        return order.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # nodes that never hooked are the roots of those that did
    roots = hooked.select(F.col("to").alias("node"), F.col("to")).distinct().join(hooked.select("node"), "node", "left_anti")
    every = hooked.unionByName(roots)
    smallest = every.groupBy("to").agg(F.min("node").alias("root"))
    return every.join(smallest, "to").select("node", "root")
