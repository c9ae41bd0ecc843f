"""Column profiles over the long cell relation, and the table and column filters on top of them."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.channels import DATE, NUM, TEXT, TIME


def value_key(kind="kind"):
    """One comparable string per cell value; null for a missing value."""
    return F.coalesce(
        F.col("txt"),
        F.when(F.col(kind) != TEXT, F.coalesce(F.col("num").cast("string"), F.col("ts").cast("string"))),
    )


DIGEST_CHARS = 64


def digest(txt):
    """Stand-in of a long text for counting distinct values, so that texts are not shuffled."""
    short = F.concat_ws(":", F.char_length(txt).cast("string"), F.sha2(txt, 256))
    return F.when(F.char_length(txt) > DIGEST_CHARS, short).otherwise(txt)


def profile(cells, keys=("table_id",)):
    """Per (keys, column): rows, non-null, distinct, ratios, longest text, kind.

    Two aggregations: by value, then by column. Both combine before shuffling, so a hot value or
    a huge column costs one partial row per task, and no set of values is ever held in memory.
    Values are grouped in their own type.
    """
    txt = F.col("txt")
    by_value = (
        cells.select(
            *keys, "col", "col_ord", "kind", "num", "ts",
            digest(txt).alias("txt"),
            F.coalesce(F.char_length(txt), F.lit(0)).alias("_chars"),
        )
        .groupBy(*keys, "col", "col_ord", "kind", "num", "ts", "txt")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_chars").alias("_chars"))
    )
    seen = F.col("num").isNotNull() | F.col("ts").isNotNull() | F.col("txt").isNotNull()
    out = by_value.groupBy(*keys, "col", "col_ord", "kind").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(seen, F.col("_n"))), F.lit(0)).cast("bigint").alias("n_present"),
        F.count_if(seen).alias("n_distinct"),
        F.max("_chars").cast("bigint").alias("max_chars"),
    )
    return (
        out.withColumn("null_ratio", (F.col("n_rows") - F.col("n_present")) / F.col("n_rows"))
        .withColumn("distinct_ratio", F.col("n_distinct") / F.col("n_rows"))
        .withColumn("is_date", F.col("kind").isin(DATE, TIME))
        .withColumn("is_num", F.col("kind") == NUM)
        .withColumn("is_long_text", F.col("max_chars") > K.LONG_TEXT_CHARS)
    )


def approx_profile(cells, keys=("table_id",), rsd=0.01):
    """Like ``profile`` with a distinct-count sketch: one aggregation, for whole huge tables."""
    value = value_key()
    out = cells.groupBy(*keys, "col", "col_ord", "kind").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_present"),
        F.approx_count_distinct(value, rsd).alias("n_distinct"),
        F.coalesce(
            F.max(F.when(F.col("kind") == TEXT, F.char_length(value))), F.lit(0)
        ).cast("bigint").alias("max_chars"),
    )
    return out.withColumn(
        "null_ratio", (F.col("n_rows") - F.col("n_present")) / F.col("n_rows")
    ).withColumn("distinct_ratio", F.col("n_distinct") / F.col("n_rows"))


def filter_small(profiled, min_rows=K.MIN_PROBE_ROWS):
    """Tables with enough rows in the profiled chunk."""
    return profiled.where(F.col("n_rows") >= min_rows)


def table_widths(profiled, keys=("table_id",)):
    """Feature count (columns less the target) per table: the highest column number, from 0."""
    return profiled.groupBy(*keys).agg((F.max("col_ord")).cast("bigint").alias("n_features"))


def filter_wide(profiled, max_features, keys=("table_id",)):
    """Drop tables with more feature columns than the limit; no limit keeps all."""
    if max_features is None:
        return profiled
    keep = table_widths(profiled, keys).where(F.col("n_features") <= max_features)
    return profiled.join(keep.select(*keys), list(keys), "left_semi")


def long_text_columns(profiled):
    return profiled.where(F.col("is_long_text"))


def target_candidates(
    profiled, max_null=K.MAX_NULL_RATIO, max_distinct=K.MAX_DISTINCT_RATIO
):
    """Columns fit as targets by type: numbers with few nulls, other columns with few values.

    Inclusive limits; dates, times and all-null columns never qualify. Adds ``task``.
    """
    regression = F.col("is_num") & (F.col("null_ratio") <= max_null)
    classification = ~F.col("is_num") & (F.col("distinct_ratio") <= max_distinct)
    usable = profiled.where((F.col("n_present") > 0) & ~F.col("is_date"))
    return usable.where(regression | classification).withColumn(
        "task", F.when(F.col("is_num"), "regression").otherwise("classification")
    )


def rule_candidates(
    profiled, max_null=K.MAX_NULL_RATIO, max_distinct=K.MAX_DISTINCT_RATIO
):
    """Columns fit as targets by rule: no long text, no date, both ratios strictly below limits."""
    return profiled.where(
        ~F.col("is_long_text")
        & ~F.col("is_date")
        & (F.col("distinct_ratio") < max_distinct)
        & (F.col("null_ratio") < max_null)
    )


def first_non_null(cells, keys=("table_id", "chunk_id")):
    """First present value per column, by row order; partial aggregation keeps one per task."""
    present = F.when(value_key().isNotNull(), F.struct("row_ord", value_key().alias("v")))
    return cells.groupBy(*keys, "col").agg(
        F.min(present)["row_ord"].alias("first_row"), F.min(present)["v"].alias("first_value")
    )


def all_null_columns(cells, keys=("table_id",), among=None):
    """(keys, column) pairs without any value, optionally among the cells where ``among`` holds."""
    value = value_key() if among is None else F.when(among, value_key())
    counts = cells.groupBy(*keys, "col").agg(F.count(value).alias("_n"))
    return counts.where(F.col("_n") == 0).drop("_n")


def drop_all_null(cells, keys=("table_id",), among=None):
    """Cells of columns that hold a value; ``among=~is_query`` looks at context rows only.

    The dropped columns are a list of (keys, column): one entry per column at most, balanced keys.
    """
    return cells.join(all_null_columns(cells, keys, among), [*keys, "col"], "left_anti")
