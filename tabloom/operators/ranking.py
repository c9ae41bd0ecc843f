"""Ranks of unbounded groups without sorting a whole group in one task."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw_bucket

BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def bounded(df, rows):
    """Broadcast hint for a side proven to hold at most ``rows`` short rows, if that is small.

    ``rows`` None means no bound is known; then the join strategy is left to Spark.
    """
    return F.broadcast(df) if rows is not None and rows * ROW_BYTES <= BROADCAST_BYTES else df


def _offsets(df, keys, bucket):
    """Per (keys, bucket): rows of the group in lower buckets, and in all. One row per bucket."""
    hist = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*keys)
    before = group.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return hist.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )


def bucketed_rank(df, keys, bucket, order, out="rank", max_offsets=None, total=None):
    """0-based rank of each row inside its group, for groups of any size.

    ``bucket`` must rise with ``order``. Rows are sorted inside a bucket only; a small histogram
    of bucket sizes gives each bucket its starting rank. ``max_offsets`` bounds its row count.
    ``total`` names a column for the size of the group.
    """
    marked = df.withColumn("_bucket", bucket)
    local = W.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = (
        marked.withColumn("_local", F.row_number().over(local) - 1)
        .join(bounded(_offsets(marked, keys, "_bucket"), max_offsets), [*keys, "_bucket"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
    )
    if total is not None:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_bucket", "_local", "_before", "_total")


def draw_rank(df, keys, drawn, ties, out="rank", bits=10, max_groups=None, total=None):
    """Rank by a draw column, the permutation used by row-level sampling of whole tables.

    2^bits buckets; pick bits so that group rows / 2^bits sort comfortably in one task.
    """
    order = [F.col(drawn), *[F.col(t) for t in ties]]
    offsets = None if max_groups is None else max_groups << bits
    return bucketed_rank(df, keys, draw_bucket(drawn, bits), order, out, offsets, total)


def first_by_draw(df, keys, drawn, ties, n, out="rank", bits=16, max_groups=None):
    """The n rows of each group with the lowest draws, ranked; groups may be of any size.

    The bucket histogram shows which buckets can hold one of the n rows. Only those rows are
    shuffled and sorted, about n + group rows / 2^bits of them. At most n buckets per group
    matter, so with ``max_groups`` given the list of them has a proven bound.
    """
    marked = df.withColumn("_bucket", draw_bucket(drawn, bits))
    reach = _offsets(marked, keys, "_bucket").where(F.col("_before") < n)
    reach = bounded(reach.drop("_before", "_total"), None if max_groups is None else max_groups * n)
    local = W.partitionBy(*keys).orderBy(F.col(drawn), *[F.col(t) for t in ties])
    return (
        marked.join(reach, [*keys, "_bucket"], "left_semi")
        .withColumn(out, (F.row_number().over(local) - 1).cast("bigint"))
        .where(F.col(out) < n)
        .drop("_bucket")
    )
