"""Connected components of a link table, by alternating star contraction.

Every round is two aggregations with map-side minima: first each node hands its larger neighbours to its smallest
neighbour, then each node hands its smaller ones there too. Links turn into stars around the smallest node of each
component in a logarithmic number of rounds, however long the chains are. Each round is written to the shared checkpoint
folder, so a lost executor costs a re-read and not the whole chain of rounds. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round: links (a, b) with a > b become (member, smallest neighbour of the node between)."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = sides.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is the smallest node that can be reached.

    Loops, repeated links and links given in either direction are allowed; links with a null end are no links. An empty
    table gives an empty result.
    """
    now = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        state = (sums["n"], sums["x"])
        if state == before or not sums["n"]:
            break
        before = state
        now = cut_lineage(_star(_star(now, True), False), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
