"""Row sampling: caps, shuffles, context/query splits, query chunks, bags.

Groups called *samples* are chunk-bounded (a few thousand rows), so a window per sample is safe
at any corpus size. Operators that take whole tables use the bucketed ranks of ``ranking``.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.draws import draw, draw_between
from .ranking import bounded, bucketed_rank, draw_rank, first_by_draw

SAMPLE = ("table_id", "chunk_id")


def whole(keys, *more):
    """A sample as a window. Its chunk is compared first: sorts tell most rows apart by eight bytes of their first
    column, which the names of tables share."""
    return W.partitionBy(*sorted(keys, key=lambda k: k != "chunk_id"), *more)


def deal_samples(rows, keys=("chunk_id",), per_task=None, n_rows=None):
    """Whole samples to tasks of about ``per_task`` rows, however many rows there are.

    Windows per sample need no exchange after it when ``keys`` are among theirs; name no column of one
    value only. An exchange of theirs would go by packed bytes, few for rows that take much room when
    sorted, and tasks of a union add up. The rows are counted first, which for a scan reads footers, unless
    ``n_rows`` gives their number.
    """
    tasks = -(-(rows.count() if n_rows is None else n_rows) // (per_task or K.TASK_ROWS))
    return rows.repartition(max(1, tasks), *keys)


def order_rows(rows, seed, keys=SAMPLE, cap=None, shuffle=False, row="row_ord", keep=None):
    """1-based position of each row in its sample, as ``pos``, and the sample size, as ``n_rows``.

    Larger samples are cut to ``cap`` random rows, which then come in random order; ``shuffle``
    orders the rest at random as well. One exchange by sample key serves all of it. ``keep``: whether a
    sample stays, a window over its keys, which is counted in the same pass.
    """
    sample = whole(keys)
    pos, sizes = F.col(row), F.count(F.lit(1)).over(sample)
    rows = rows.withColumns({"_n": sizes} | ({} if keep is None else {"_keep": keep}))
    if keep is not None:
        rows = rows.where("_keep").drop("_keep")
    if cap is not None:
        picked = draw(seed, "row_cap", *keys, row)
        rows = rows.withColumn("_pos", F.when(F.col("_n") > cap, picked).otherwise(F.col(row)))
        rank = F.row_number().over(sample.orderBy("_pos", row))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_pos")
        rows = rows.withColumn("_n", F.least("_n", F.lit(int(cap)).cast("bigint")))
        pos = F.col("_rank")
    if shuffle:
        pos = draw(seed, "row_order", *keys, row)
    rows = rows.withColumn("_pos", pos)
    out = rows.withColumn("pos", F.row_number().over(sample.orderBy("_pos", row)).cast("bigint"))
    return out.withColumn("n_rows", F.col("_n")).drop("_pos", "_rank", "_n")


def sample_rows(rows, n, seed, keys=SAMPLE, row="row_ord"):
    """Up to n random rows of each sample, in random order."""
    return order_rows(rows, seed, keys, cap=n, row=row)


def sample_table_rows(rows, n, seed, keys=("table_id",), row="row_ord", max_groups=None):
    """Up to n random rows of tables of any size."""
    drawn = rows.withColumn("_d", draw(seed, "row_cap", *keys, row))
    return first_by_draw(drawn, keys, "_d", [row], n, "pos", max_groups=max_groups).drop("_d")


def shuffle_rows(rows, seed, keys=SAMPLE, row="row_ord"):
    return order_rows(rows, seed, keys, shuffle=True, row=row)


def split_context(ordered, seed=0, fit_size=None, query_range=None, keys=SAMPLE):
    """Mark query rows of ordered rows: ``is_query = pos > fit_rows``.

    ``query_range``: query size drawn from a closed range fitted to the sample; it wins over
    ``fit_size``, a number of rows or a fraction. Both sides must get a row.
    """
    n = F.col("n_rows")
    if query_range is not None:
        lo, hi = sorted(int(q) for q in query_range)
        top = F.least(F.lit(hi).cast("bigint"), n - 1)
        low = F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(lo).cast("bigint"), top))
        fit = n - draw_between(low, F.greatest(top, low), seed, "query_rows", *keys)
    elif fit_size is None:
        raise ValueError("give fit_size or query_range")
    elif isinstance(fit_size, bool):
        raise ValueError("fit_size is a number of rows or a fraction in (0, 1)")
    elif isinstance(fit_size, float):
        if not 0 < fit_size < 1:
            raise ValueError("fit_size as a fraction must lie in (0, 1)")
        fit = F.floor(n * F.lit(fit_size)).cast("bigint")
    else:
        fit = F.lit(int(fit_size)).cast("bigint")
    refuse = F.raise_error(F.lit("the split must leave a row for context and for query"))
    fit = F.when((fit >= 1) & (fit < n), fit).otherwise(refuse.cast("bigint"))
    return ordered.withColumn("fit_rows", fit).withColumn("is_query", F.col("pos") > F.col("fit_rows"))


def stack_context_query(context, query):
    """Context and query rows as one relation."""
    return context.withColumn("is_query", F.lit(False)).unionByName(
        query.withColumn("is_query", F.lit(True))
    )


def query_chunk_of(size=None):
    """Number of the query chunk a query row of a split sample falls in; by default all in one."""
    if size is None:
        return F.lit(0).cast("bigint")
    if int(size) <= 0:
        raise ValueError("the query chunk size must be positive")
    return F.floor((F.col("pos") - F.col("fit_rows") - 1) / int(size)).cast("bigint")


def query_chunks(rows, size=None):
    """Query rows of split samples with their ``query_chunk``."""
    return rows.where("is_query").withColumn("query_chunk", query_chunk_of(size))


def table_query_chunks(rows, size=K.QUERY_CHUNK_ROWS, index="row_ord"):
    """``query_chunk`` for a whole query table with a dense row index; no shuffle."""
    if int(size) <= 0:
        raise ValueError("the query chunk size must be positive")
    return rows.withColumn("query_chunk", F.floor(F.col(index) / int(size)).cast("bigint"))


def dense_index(rows, keys=("table_id",), order="row_ord", out="idx", span=1_000_000):
    """0-based dense index by a sparse integer order column, for tables of any size."""
    return bucketed_rank(rows, keys, F.floor(F.col(order) / span), [F.col(order)], out)


def bootstrap_bags(
    rows, bags, m, seed, keys=("table_id",), index="row_ord", max_groups=None
):
    """Exactly m rows with replacement per bag: columns bag and slot are added.

    The draws are a small table of bags × m row numbers per group; the rows, with their dense
    index, are only filtered by it. With ``max_groups`` known the draws have a proven size.
    """
    if bags < 1 or m < 1:
        raise ValueError("bags and rows per bag must be positive")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = sizes.select(
        *keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag")
    ).select(*keys, "_n", "bag", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot"))
    draws = slots.select(
        *keys,
        "bag",
        "slot",
        (draw(seed, "bootstrap", *keys, "bag", "slot") % F.col("_n")).alias(index),
    )
    limit = None if max_groups is None else max_groups * bags * m
    return rows.join(bounded(draws, limit), [*keys, index])


def sliding_bags(rows, m, seed, keys=("table_id",), row="row_ord", max_bags=K.MAX_AUTO_BAGS, max_groups=None):
    """Overlapping windows over one permutation of each table, spread evenly from end to end.

    B = min(max_bags, ceil(N / m)) bags of m rows; up to m rows make a single bag.
    """
    drawn = rows.withColumn("_d", draw(seed, "bag_order", *keys, row))
    ranked = draw_rank(drawn, keys, "_d", [row], "_r", max_groups=max_groups, total="_n").drop("_d")
    n, b = F.col("_n"), F.col("_b")
    counted = ranked.withColumn(
        "_b", F.least(F.lit(max_bags), F.ceil(n / F.lit(m))).cast("bigint")
    )
    start = lambda bag: F.floor((n - m) / F.greatest(b - 1, F.lit(1)) * bag)
    holds = lambda bag: (b == 1) | (
        (F.col("_r") >= start(bag)) & (F.col("_r") < start(bag) + m)
    )
    spread = F.filter(F.sequence(F.lit(0).cast("bigint"), b - 1), holds)
    return (
        counted.withColumn("bag", F.explode(spread))
        .withColumn(
            "slot",
            F.when(b == 1, F.col("_r")).otherwise(F.col("_r") - start(F.col("bag"))).cast("bigint"),
        )
        .drop("_r", "_n", "_b")
    )


def cap_context(rows, m, seed, keys=("table_id",), row="row_ord", max_groups=None):
    """A single bag: m random rows without replacement, or all rows if there are no more."""
    out = sample_table_rows(rows, m, seed, keys, row, max_groups)
    return out.withColumn("bag", F.lit(0)).withColumnRenamed("pos", "slot")


def make_bags(rows, bagging, m, seed, keys=("table_id",), index="row_ord", max_groups=None):
    """Bags by configuration: ``"auto"``, one capped bag, or that many bootstrap bags."""
    if bagging == "auto":
        return sliding_bags(rows, m, seed, keys, index, max_groups=max_groups)
    if not isinstance(bagging, int) or isinstance(bagging, bool) or bagging < 1:
        raise ValueError('bagging must be "auto" or a positive integer')
    if bagging == 1:
        return cap_context(rows, m, seed, keys, index, max_groups)
    return bootstrap_bags(rows, bagging, m, seed, keys, index, max_groups)


def plan_scoring(chunks, bags):
    """Every query chunk once per bag."""
    if bags < 1:
        raise ValueError("at least one bag is needed")
    return chunks.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
