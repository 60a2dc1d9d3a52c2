"""Connected components by alternating large and small stars.

Every round links the neighbours of each node to the least of them, on the upper and then on the
lower side, until each node hangs on the least node of its component. The rounds grow with the
logarithm of a component's width. No list of neighbours is ever built: a round is a minimum by
node, which each task reduces before the shuffle, and a join back that may be split where a node
has very many neighbours, because the minima are a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import small
from tomeweave.sources.workspace import materialise


# Rows up to which a table of minima is broadcast.
SMALL = 500_000


def _star(links: DataFrame, upper: bool) -> DataFrame:
    """Links ``u > v`` after one star over all nodes, perhaps repeated."""
    if upper:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = materialise(least.select("u", F.least("u", "m").alias("m")), "star-least")
    joined = both.join(small(least, SMALL), "u")
    if upper:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v")


def _mark(links: DataFrame) -> tuple:
    """Two sets of links that agree in this are taken to be equal."""
    sums = [F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1)]
    return tuple(links.agg(F.count("*"), *sums).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` that has a link; a component is its least node.

    Loops and repeated links do no harm. An empty table gives no rows.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = materialise(edges.where("a <> b").select(high, low).distinct(), "links")
    mark = _mark(links)
    while True:
        links = materialise(_star(_star(links, upper=True), upper=False).distinct(), "star")
        last, mark = mark, _mark(links)
        if mark == last:
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
