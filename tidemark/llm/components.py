"""Connected components of a table of links, by alternating stars: every step is a grouped minimum and a join, so a hub
with very many links is pre-aggregated and its join can be split, and the number of steps grows with the logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(links: DataFrame) -> DataFrame:
    """links (u, v): of each u the least of itself and its v, linked with those of the v that `links` gives to it."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return links.join(least, "u")


def components(links: DataFrame, into: list | None = None) -> DataFrame:
    """links: columns a, b. Gives node, component for every linked node, component being the least node it reaches.
    into: a list that gets the stored table that the result reads."""
    e = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links"
    )
    last = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if state == last or not state[0]:
            break
        last = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        before, e = e, stored(small.filter("u > v").distinct(), "stars")
        discard([before])
    if into is not None:
        into.append(e)
    own = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        own.select("node", F.col("node").alias("component"))
    )
