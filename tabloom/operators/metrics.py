"""Evaluation metrics per group of samples. Only query rows count; denominators are at least 1."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.channels import finite


def _share(total, count):
    return total / F.greatest(count, F.lit(1))


def log_loss(scores, keys, row, truth="truth", class_col="class_idx", score="score"):
    """Mean over query rows of -log softmax(score)[truth]. ``scores``: a row per query and class."""
    w = W.partitionBy(*keys, row)
    shifted = scores.withColumn("_top", F.max(score).over(w))
    hit = F.when(F.col(class_col) == F.col(truth), F.col(score))
    per_row = shifted.groupBy(*keys, row).agg(
        (F.max("_top") + F.ln(F.sum(F.exp(F.col(score) - F.col("_top"))))).alias("_lse"),
        F.max(hit).alias("_hit"),
    )
    loss = F.coalesce(F.col("_lse") - F.col("_hit"), F.lit(0.0))
    return per_row.groupBy(*keys).agg(
        _share(F.sum(loss), F.count(F.lit(1))).alias("log_loss")
    )


def accuracy(preds, keys, pred="pred", truth="truth"):
    """Share of query rows whose prediction is the truth."""
    hits = F.count_if(F.col(pred) == F.col(truth))
    return preds.groupBy(*keys).agg(_share(hits, F.count(F.lit(1))).alias("accuracy"))


def majority_code(rows, keys, code):
    """Most frequent context code per key, ties to the smallest; combines before the shuffle."""
    counts = rows.where(~F.col("is_query")).groupBy(*keys, code).agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct((-F.col("_n")).alias("n"), F.col(code).alias("c"))
    return counts.groupBy(*keys).agg(F.min_by(code, order).alias("base_code"))


def baseline_lift(rows, keys, pred="pred", code="truth"):
    """Accuracy above always answering the majority context code, scaled to [0, 1].

    ``rows`` holds context and query rows; pred is set on query rows.
    """
    base = majority_code(rows, keys, code)
    queries = rows.where("is_query").join(base, list(keys), "left")
    hits = lambda guess: _share(F.count_if(F.col(guess) == F.col(code)), F.count(F.lit(1)))
    out = queries.groupBy(*keys).agg(hits(pred).alias("acc"), hits("base_code").alias("base_acc"))
    lift = (F.col("acc") - F.col("base_acc")) / (1.0 - F.col("base_acc") + 1e-5)
    return out.withColumn("lift", F.least(F.greatest(lift, F.lit(0.0)), F.lit(1.0)))


def _tame(pred):
    return F.coalesce(finite(F.col(pred)), F.lit(0.0))


def mse_clipped(rows, keys, pred="pred", truth="truth"):
    """Mean squared error within [0, 10]; a prediction that is not finite counts as 0."""
    err = _tame(pred) - F.col(truth)
    mean = _share(F.sum(err * err), F.count(F.lit(1)))
    return rows.groupBy(*keys).agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(10.0)).alias("mse"))


def r2_clipped(rows, keys, pred="pred", truth="truth"):
    """1 - residual / total variation within [-1, 1]; 0 when the truth does not vary.

    The total is n times the population variance, one stable aggregation instead of two passes.
    """
    err = _tame(pred) - F.col(truth)
    out = rows.groupBy(*keys).agg(
        F.sum(err * err).alias("_res"),
        (F.var_pop(truth) * F.count(F.lit(1))).alias("_tot"),
    )
    raw = F.when(F.col("_tot") > 0, 1.0 - F.col("_res") / F.col("_tot")).otherwise(F.lit(0.0))
    return out.select(*keys, F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0)).alias("r2"))
