"""Encoders fitted to bags: a bag is encoded once, queries look its statistics up.

``fit_encoder`` encodes the rows of the bags, a bounded number, and keeps what the encoding found out
on one row a bag: the features that vary in the context, their order and padding, presence flags, and
edges or means, limits and deviations of numbers. ``encode_queries`` puts that row beside each query and
applies the same expressions with the statistics given, so no bag is copied to query chunks and
a prediction does not depend on which queries share its chunk (but for infinite values, which are drawn
in to the finite range of the chunk, as ever).
"""

from functools import lru_cache

import pandas as pd
import pyarrow.dataset as pads
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.channels import NUM, TIME
from ..operators import columns as C
from ..operators import encode as E
from ..operators import sampling as S
from ..sources.scan import open_path
from ..sources.shared import fresh_path, stage
from .encode_sample import coded, lay_out
from .prepare import decide_columns


def _numbers(kind, target):
    return [c for c, k in kind.items() if c != target and k in (NUM, TIME)]


def _statistics(columns, regression):
    if regression == "l2":
        return [f"{c}__{e}" for c in columns for e in ("fill", "lim", "m", "s", "k")]
    return [f"{c}__clamped__mid" for c in columns]


def fit_encoder(bags, target, task, config, regression="l2", classification="cross-entropy", bins=K.NUM_BINS, scale=None):
    """(context cells, state, channel of each column) of bags: rows with bag, row_ord, features, target.

    The state has one row a bag. Which columns vary is decided on the context alone.
    """
    keys = ("bag",)
    rows = bags.withColumn("is_query", F.lit(False))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("bag").orderBy("row_ord")).cast("bigint"))
    ready, kind = decide_columns(rows, target, config, keys)
    done = coded(
        ready, kind, target, task, keys, regression, classification, "valid", config.seed, bins, scale, state=E.KEPT
    )
    done = done.withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy("bag")))
    done = stage(done, "fitted")  # at most bags x rows of a bag
    held = [f"`{c}`" for c in _statistics(_numbers(kind, target), regression)]
    state = done.where("pos = 1").select("bag", "columns", "_present", "_rows", *held)
    return lay_out(done, kind, target, task, keys, regression), state, kind


def encode_queries(queries, state, target, task, config, kind, index="row_ord", chunk=K.QUERY_CHUNK_ROWS, regression="l2", bins=K.NUM_BINS):
    """Encoded cells of every query with every bag, by (bag, query_chunk); the bags' own cells stay out."""
    cut = S.table_query_chunks(queries, chunk, index).withColumnRenamed(index, "row_ord")
    cut = cut.withColumn("is_query", F.lit(True))
    cut = cut.withColumn("_nth", F.row_number().over(W.partitionBy("query_chunk").orderBy("row_ord")))
    rows, _ = C.normalise(cut, config.times, exclude=("query_chunk", "_nth", "row_ord", "is_query"))
    numbers = _numbers(kind, target)
    if numbers and regression != "l2":
        rows = E.clamp_inf(rows, numbers, ["query_chunk"])
    rows = rows.crossJoin(F.broadcast(state))  # one row a bag
    if numbers and regression == "l2":
        rows = E.standardise(rows, numbers, ["bag"], "feature", "valid", E.GIVEN)
    elif numbers:
        clamped = [f"{c}__clamped" for c in numbers]
        rows = E.code_bins(rows, clamped, ["bag"], bins, state=E.GIVEN)
        rows = rows.withColumnsRenamed({f"{k}__code": f"{c}__code" for c, k in zip(numbers, clamped)}).drop(*clamped)
    rows = rows.withColumns(
        {
            "pos": (F.col("_rows") + F.col("_nth")).cast("bigint"),
            "target": F.lit(K.HIDDEN).cast("double"), "target_delta": F.lit(0.0), "truth": F.lit(None).cast("double"),
            "_label": F.lit(None).cast("string"),
        }
    )
    return lay_out(rows, kind, target, task, ("bag", "query_chunk"), regression)


@lru_cache(maxsize=2)
def _bag(path, bag):
    fs, inner = open_path(path)
    return pads.dataset(inner, filesystem=fs, format="parquet").to_table(filter=pads.field("bag") == bag).to_pandas()


def score_with_bags(cells, queries, scorer, schema):
    """Scores of a user's scorer, which sees a bag's cells above those of one query chunk.

    A bag's cells are read from the shared folder by the task that needs them, two bags at a time.
    """
    path = fresh_path(cells.sparkSession, "bag-cells")
    cells.write.parquet(path)

    def run(group):
        context = _bag(path, int(group["bag"].iloc[0])).assign(query_chunk=group["query_chunk"].iloc[0])
        return scorer(pd.concat([context[list(group.columns)], group], ignore_index=True))

    return queries.groupBy("bag", "query_chunk").applyInPandas(run, schema)
