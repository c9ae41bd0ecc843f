"""Connected components by alternating star contraction, without gathering any neighbourhood."""

from pyspark.sql import functions as F

from ..sources.shared import stage


def _state(edges):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links):
    """(node, root) of every node of links (a, b), root being the smallest node it reaches.

    Each round lets every node point its larger, then its smaller neighbours to the smallest one
    known; edges never grow in number and the rounds grow with the logarithm of the longest path.
    Rounds are written to the shared folder, so a lost executor repeats one round at most.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    edges = stage(pairs.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u > v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        edges = stage(small.filter("u > v").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return edges.union(roots).toDF("node", "root")
