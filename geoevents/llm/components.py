"""Connected components of a link table by random contraction.

Every round gives each node a fresh random priority, sends it to the node of least priority among itself and its neighbours, and
contracts the links. A constant share of nodes goes each round whatever the shape (chain, star, clique), so rounds grow with the
logarithm of the longest chain; the loop ends when no link is left and by nothing else. Minima are partial aggregates, so a hub is
reduced before the shuffle; labels are joined by plain equi-joins whose large side AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import cut


def _order(col: str, round_no: int):
    return F.struct(F.xxhash64(F.col(col), F.lit(round_no)).alias("p"), F.col(col).alias("n"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) to (node, root); only nodes that have a link. Self links, repeated and null rows are allowed; null
    ends are dropped. An empty table gives an empty one."""
    edges = cut(links.select("a", "b").filter("a is not null and b is not null and a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, round_no = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_order("b", round_no)).alias("o"))
        to = cut(best.select(F.col("a").alias("n"), F.least(F.col("o"), _order("a", round_no))["n"].alias("to")))
        if labels is None:
            labels = to.select(F.col("n").alias("node"), F.col("to").alias("root"))
        else:
            moved = to.select(F.col("n").alias("root"), "to")
            labels = cut(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left, right = to.select(F.col("n").alias("a"), F.col("to").alias("x")), to.select(F.col("n").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(left, "a").join(right, "b").filter("x <> y")
                    .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        round_no += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
