"""Connected components of a table of links, by alternating large and small stars; nothing is gathered on the driver.

Defined cases: links with a null end and links of a node to itself tie nothing; repeated links count once; no links give no rows;
ties can't occur, as the root is the smallest node. Columns other than u and v are not read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the smallest node that it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links of any ordered type to (node, root): root is the smallest node of the component; every linked node has a row."""
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.saved(edges.select("u", "v").where("u != v").distinct(), "links")
        before = None
        for _ in range(most_rounds):
            last, edges = edges, scratch.saved(_small_star(_large_star(edges)).distinct(), "stars")
            scratch.drop(last)
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 1000033)).first())
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
        scratch.keep(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
