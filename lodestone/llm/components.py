"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut_lineage


class _Rounds:
    """Tables in the shared checkpoint folder that each round overwrites.

    They are written instead of checkpointed, as a checkpoint keeps the estimated size of its plan: the product of
    both sides of a join, whose digits double with each round until planning takes longer than the work.
    """

    def __init__(self, links: DataFrame):
        self.first = cut_lineage(links)
        self.spark = links.sparkSession
        self.folder = f"{self.spark.sparkContext.getCheckpointDir()}/components-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def done(self) -> None:
        for name in self.names:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/{name}")


def _star(links: DataFrame, large: bool, rounds: _Rounds) -> DataFrame:
    """Each end moves to the smallest neighbour of the other end; a > b in all links in and out.

    The minima are written before they are joined back, so that Spark may split the rows of a hub.
    """
    around = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = rounds.keep("least", around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    moved = around.join(least, "a")
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return rounds.keep("large" if large else "small", out.filter(F.col("a") > F.col("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``links(a long, b long)``.

    Rounds go on until nothing moves, a logarithmic number.  Loops, repeats and both directions of a link
    are allowed; nodes without a link to another one are not in the result.
    """
    rounds = _Rounds(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    now, state = rounds.first, None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or mark == state:
            break
        state = mark
        now = _star(_star(now, True, rounds), False, rounds)
    out = cut_lineage(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct())
    rounds.done()
    return out
