"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: Copies of a node's minimum, each joined with a share of the node's links: a star's centre doesn't land in one task.
SALTS = 16
MAX_ROUNDS = 60


def _towards_minimum(links: DataFrame, keep: str) -> DataFrame:
    """``links`` (u, v, both ways): every v that ``keep`` admits is linked to the least of u and u's neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = links.filter(keep).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long), in any order and repeated at will: (node, component), component the least node reachable.

    Self links and links with a null end are ignored; nodes without another link are absent. Ends when a round
    changes nothing; the count and a hash sum of the links tell. No link reaches the driver.
    """
    now = cut(
        edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    told = None
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _towards_minimum(both, "v > u").filter("a <> b").distinct()
        # small star: only links to lesser nodes, and the node itself joins its least neighbour
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _towards_minimum(down, "true").unionAll(down.groupBy("u").agg(F.min("v").alias("b")).select(F.col("u").alias("a"), "b"))
        now = cut(small.filter("a <> b").distinct())
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if told == (mark.n, mark.h):
            break
        told = (mark.n, mark.h)
    else:
        raise RuntimeError(f"components: no fixed point in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
