"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour; rounds are written to the
shared folder, so that lineage stays short and a lost executor costs no more than a round.
A node with very many links only meets aggregates that combine before the shuffle, and joins
whose other side is unique, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    else:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``links``: long columns a and b. Returns (node, root), the root being the smallest
    node of the component; nodes without links are absent."""
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        former, links = links, written(_stars(_stars(links, large=True), large=False), "links")
        discard(former)
        # the same links again: every node points at its root
        state = links.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct()
            )
        before = state
