"""From per-bag scores to predictions: alignment, softmax, bag combination, argmax."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import as_col
from ..sources.shared import stage

TOLERANCE = 1e-4
NEG_INF = float("-inf")


def align_classes(scores, classes, keys, class_col="class", score="score", fill=None):
    """Every score row re-indexed to the full class list; a missing class gets the fill value.

    ``classes``: one row per class (class column), the same for all score rows. Each score row is
    folded to one row with a small map, then unfolded over the list, so the result is built
    without joining rows with classes pair by pair.
    """
    fill = NEG_INF if fill is None else fill
    listed = classes.agg(F.sort_array(F.collect_set(class_col))).scalar()
    folded = scores.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(class_col, score))).alias("_m")
    )
    opened = folded.select(*keys, "_m", F.explode(listed).alias(class_col))
    found = F.coalesce(F.try_element_at("_m", F.col(class_col)), F.lit(fill))
    return opened.select(*keys, class_col, found.alias(score))


def softmax(scores, keys, score="score", out="prob"):
    """Softmax over the rows that share keys, shifted by their maximum."""
    w = W.partitionBy(*keys)
    shifted = scores.withColumn("_e", F.exp(as_col(score) - F.max(score).over(w)))
    return shifted.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def looks_like_probabilities(scores, keys, row_keys, score="score"):
    """Per keys: are all scores within [0, 1] and all row sums 1, up to tolerance?"""
    per_row = scores.groupBy(*keys, *row_keys).agg(
        F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.sum(score).alias("_sum")
    )
    fine = (
        (F.col("_lo") >= -TOLERANCE)
        & (F.col("_hi") <= 1 + TOLERANCE)
        & (F.abs(F.col("_sum") - 1.0) <= 2 * TOLERANCE)
    )
    return per_row.groupBy(*keys).agg(
        F.coalesce(F.bool_and(fine), F.lit(False)).alias("is_probability")
    )


def argmax(scores, keys, class_col="class", score="score"):
    """Best class per keys; a tie goes to the first class."""
    order = F.struct((-as_col(score)).alias("s"), F.col(class_col).alias("c"))
    return scores.groupBy(*keys).agg(
        F.min_by(class_col, order).alias("pred"), F.max(score).alias("pred_score")
    )


def combine_bags_cls(scores, keys, n_bags, mode, bag="bag", class_col="class", score="score"):
    """(keys, class, prob) from per-bag scores.

    mode ``similarity``: softmax of the best score over bags. ``probability``: mean over bags.
    ``logit``: mean over bags of the softmax within a bag. A class absent from a bag scores minus
    infinity there, or probability 0, so missing rows need not exist.
    """
    if n_bags < 1:
        raise ValueError("at least one bag is needed")
    if mode == "similarity":
        best = scores.groupBy(*keys, class_col).agg(F.max(score).alias("_s"))
        return softmax(best, keys, "_s").drop("_s")
    if mode == "probability":
        return scores.groupBy(*keys, class_col).agg((F.sum(score) / n_bags).alias("prob"))
    if mode != "logit":
        raise ValueError("mode is similarity, probability or logit")
    per_bag = softmax(scores, [*keys, bag], score, "_p")
    return per_bag.groupBy(*keys, class_col).agg((F.sum("_p") / n_bags).alias("prob"))


def combine_bags_auto(scores, keys, n_bags, bag="bag", class_col="class", score="score"):
    """Mean of probabilities when the scores of every bag look like such, else of softmaxes.

    Both means and the check are carried side by side and written once, so what makes the scores, a
    user's scorer perhaps, runs once.
    """
    w = W.partitionBy(*keys, bag)
    fine = (
        (F.min(score).over(w) >= -TOLERANCE)
        & (F.max(score).over(w) <= 1 + TOLERANCE)
        & (F.abs(F.sum(score).over(w) - 1.0) <= 2 * TOLERANCE)
    )
    per_bag = softmax(scores, [*keys, bag], score, "_p").withColumn("_fine", F.coalesce(fine, F.lit(False)))
    both = per_bag.groupBy(*keys, class_col).agg(
        (F.sum(score) / n_bags).alias("_mean"), (F.sum("_p") / n_bags).alias("_soft"), F.bool_and("_fine").alias("_fine")
    )
    both = stage(both, "combined")
    all_fine = bool(both.agg(F.bool_and("_fine")).first()[0])
    return both.select(*keys, class_col, F.col("_mean" if all_fine else "_soft").alias("prob"))


def combine_bags_reg(preds, keys, pred="pred"):
    """Mean over bags."""
    return preds.groupBy(*keys).agg(F.avg(pred).alias("pred"))


def expected_value(scores, keys, quantile="quantile", score="score", probabilities=False):
    """Sum of class probability times bin quantile; scores are softmaxed first."""
    p = scores.withColumn("_p", as_col(score)) if probabilities else softmax(scores, keys, score, "_p")
    return p.groupBy(*keys).agg(F.sum(F.col("_p") * F.col(quantile)).alias("pred"))


def unscale(rows, pred="pred", mean="mean", std="std", out="pred"):
    """Back to target units; a missing or NaN prediction counts as 0 before scaling."""
    x = F.nanvl(F.coalesce(as_col(pred), F.lit(0.0)), F.lit(0.0))
    return rows.withColumn(out, x * F.col(std) + F.col(mean))
