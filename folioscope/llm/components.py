"""Connected components of a link table, without collecting it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in the long columns `a`, `b`; root is the smallest node.

    Large-star and small-star rounds: each node's neighbours are linked to the smallest one,
    so the links never outnumber those given and a chain halves from round to round. Every
    round ends in a reliable checkpoint. The join on a node with very many neighbours is
    one that adaptive execution can split. Links with a null end and loops are ignored.
    """
    links = cut(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
        links = cut(small_star(large_star(links)))
    # Now every link leads to its component's smallest node.
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low"))
    return (
        both.join(lowest, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        .distinct()
    )


def small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    lowest = links.groupBy("a").agg(F.min("b").alias("low"))
    joined = links.join(lowest, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionByName(lowest.select("a", F.col("low").alias("b")))
        .where("a <> b")
        .distinct()
    )
