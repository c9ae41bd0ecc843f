"""In-context prediction jobs: bagged contexts, scored query rows, combined predictions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.vectors import clipped_logit, softmax_array
from ..operators import encode as E
from ..operators import neighbours as N
from ..operators import sampling as S
from ..operators import scores as O
from ..operators.ranking import bounded
from ..operators.search import bag_scores
from ..sources.shared import stage
from .encode_sample import encode
from .fitted import encode_queries, fit_encoder, score_with_bags
from .prepare import SampleConfig, decide_columns


def draw_context(context, bagging, m, seed, index="row_ord", table="predict"):
    """The bags of one context table, written once: (bags, frame).

    At most bags × m rows, whatever the size of the table. Writing them cuts the lineage, so the
    table is read once however often the bags are used.
    """
    keyed = context.withColumn("_t", F.lit(table))
    drawn = S.make_bags(keyed, bagging, m, seed, ["_t"], index, max_groups=1).drop("_t")
    held = stage(drawn, "context")
    return int(held.agg(F.max("bag")).first()[0] or 0) + 1, held


def _at(sims, bag, code, n_codes):
    return F.get(sims, bag * n_codes + code)


def _held_shares(context, queries, row, vec, label, bagging, m, seed, kind, index):
    """(shares, names): for every query row the array ``_p`` of the probabilities of ``names``, the sorted
    classes that some bag holds, of which there are at most bags × m."""
    bags, drawn = draw_context(context, bagging, m, seed, index)
    names = [r[0] for r in E.classes(drawn, label).collect()]
    listed = F.array(*[F.lit(c) for c in names])
    coded = drawn.withColumn("_code", (F.array_position(listed, F.col(label)) - 1).cast("int"))
    n = len(names)
    sims = bag_scores(queries, coded, row, vec, "_code", n, bags, kind)
    over_bags = lambda k: F.array_max(
        F.transform(F.sequence(F.lit(0), F.lit(bags - 1)), lambda b: _at("sims", b, k, n))
    )
    best = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), over_bags)
    logits = F.transform("_best", lambda s: F.when(s.isNotNull(), clipped_logit(s)))
    return sims.withColumn("_best", best).select(row, softmax_array(logits).alias("_p")), names


def predict_proba(
    context, queries, row, vec, label, bagging=8, m=K.MAX_CONTEXT_ROWS, seed=42, kind="cosine",
    index="row_ord",
):
    """(row, class, prob): class probabilities of every query row by similarity to its contexts.

    ``context``: one table with a dense row index, vectors and labels. There is a row for each class of
    that table, with probability 0 if no bag holds it. Queries stream through the scorer; bag
    maximum, logit and softmax work on the arrays in place, so queries never shuffle. Arrays hold the
    classes of the bags only; the others are joined to their rows, so no array grows with the table. A
    query without a vector has null probabilities.
    """
    labelled = context.where(F.col(label).isNotNull())
    probs, names = _held_shares(labelled, queries, row, vec, label, bagging, m, seed, kind, index)
    place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("class")) - 1
    listed = labelled.select(F.col(label).alias("class")).distinct().withColumn("_i", place.cast("int"))
    listed = stage(listed, "classes")
    absent = F.when(F.get("_p", F.lit(0)).isNotNull(), F.lit(0.0))
    prob = F.when(F.col("_i") >= 0, F.get("_p", F.col("_i"))).otherwise(absent)
    return probs.crossJoin(bounded(listed, listed.count())).select(row, "class", prob.alias("prob"))


def predict_class(
    context, queries, row, vec, label, bagging=8, m=K.MAX_CONTEXT_ROWS, seed=42, kind="cosine",
    index="row_ord",
):
    """(row, pred): the most probable class, the first one on a tie.

    A class that no bag holds has probability 0 and is never the most probable one, so the choice is made
    in the arrays of ``predict_proba`` and classes are not expanded. A query without a vector has no class.
    """
    labelled = context.where(F.col(label).isNotNull())
    probs, names = _held_shares(labelled, queries, row, vec, label, bagging, m, seed, kind, index)
    listed = F.array(*[F.lit(c) for c in names])
    shares = F.transform("_p", lambda p, i: F.struct((-p).alias("p"), F.get(listed, i).alias("c")))
    best = probs.select(row, F.array_min(shares).alias("_best"))
    chosen = F.when(F.col("_best.p").isNotNull(), F.col("_best.c"))
    return best.groupBy(row).agg(F.min_by(chosen, "_best").alias("pred"))


def predict_value(
    context, queries, row, vec, target, bagging=8, m=K.MAX_CONTEXT_ROWS, seed=42, kind="cosine",
    index="row_ord", bins=K.NUM_BINS, scale=None,
):
    """(row, pred): expected value over the quantile bins of each bag, averaged over the bags.

    NaN targets are missing targets; a query without a vector has no value.
    """
    valued = context.withColumn("_y", F.col(target).cast("double")).where("_y is not null and not isnan(_y)")
    bags, drawn = draw_context(valued, bagging, m, seed, index)
    marked = drawn.withColumn("is_query", F.lit(False))
    coded = E.quantile_bin(marked, ["_y"], ["bag"], bins, scale)
    coded = coded.withColumn("_code", F.col("_y__code.bin"))
    edges = E.sample_edges(marked, "_y", ["bag"], bins, scale)
    inner = edges.select("bag", F.slice("edges", 2, bins).alias("q"))
    parts = F.array_sort(F.collect_list(F.struct("bag", "q")))
    quantiles = inner.agg(F.flatten(F.transform(parts, lambda s: s["q"]))).scalar()
    sims = bag_scores(queries, coded, row, vec, "_code", bins, bags, kind)
    absent = F.lit(float("-inf"))
    codes = F.sequence(F.lit(0), F.lit(bins - 1))

    def bag_value(b):
        logits = F.transform(
            codes, lambda k: clipped_logit(F.coalesce(_at("sims", b, k, bins), absent))
        )
        terms = F.zip_with(
            softmax_array(logits),
            F.slice("_q", b * bins + 1, bins),
            lambda p, q: p * q,
        )
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    values = F.transform(F.sequence(F.lit(0), F.lit(bags - 1)), bag_value)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    pred = F.when(F.col("sims").isNotNull(), total / bags)
    return sims.withColumn("_q", quantiles).select(row, pred.alias("pred"))


def in_context_samples(
    context, queries, target, task, bagging=8, m=K.MAX_CONTEXT_ROWS, chunk=K.QUERY_CHUNK_ROWS,
    config=None, regression="l2", classification="cross-entropy", index="row_ord", scale=None,
):
    """Encoded cells of every (bag, query chunk): the input of a scorer.

    Both frames have a dense row index and the same feature columns; queries need no target. Each
    sample joins one bag with one query chunk, so it has at most m + chunk rows. Column choice and
    encoding see the context and the chunk; statistics come from the context alone. Returns
    (samples, number of bags, bag rows).
    """
    config = config or SampleConfig()
    features = [c for c in context.columns if c not in (target, index)]
    bags, drawn = draw_context(context, bagging, m, config.seed, index)
    drawn = drawn.withColumn("bag", F.col("bag").cast("bigint"))
    cut = S.table_query_chunks(queries.select(index, *features), chunk, index)
    last = cut.agg(F.max("query_chunk")).first()[0]
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))
    held = drawn.select("bag", F.col("slot").cast("bigint").alias(index), *features, target)
    held = held.withColumn("query_chunk", copies)
    asked = S.plan_scoring(cut, bags).withColumn("bag", F.col("bag").cast("bigint"))
    asked = asked.withColumn(target, F.lit(None).cast(context.schema[target].dataType))
    both = S.stack_context_query(held, asked.select(*held.columns))
    both = both.withColumnRenamed(index, "row_ord")
    keys = ("bag", "query_chunk")
    order = W.partitionBy(*keys).orderBy("is_query", "row_ord")
    both = both.withColumn("pos", F.row_number().over(order).cast("bigint"))
    ready, kinds = decide_columns(both, target, config, keys)
    samples = encode(
        ready, kinds, target, task, keys, regression, classification, "valid", config.seed,
        K.NUM_BINS, scale,
    )
    return samples, bags, drawn


def predict_with_scorer(
    context, queries, target, task, scorer, bagging=8, m=K.MAX_CONTEXT_ROWS, chunk=K.QUERY_CHUNK_ROWS,
    config=None, regression="l2", classification="cross-entropy", index="row_ord", scale=None,
):
    """Predictions from a user scorer over bags that are encoded once and queries encoded by their state.

    ``scorer`` takes the pandas frame of one (bag, query chunk), encoded cells in long form. For
    classification it returns (row_ord, bag, label, score); the result is (row_ord, label, prob),
    bags combined as probabilities if all look so, else by their softmax. For regression it
    returns (row_ord, bag, pred) in scaled units; the result is (row_ord, pred) in target units.
    """
    config = config or SampleConfig()
    features = [c for c in context.columns if c not in (target, index)]
    bags, drawn = draw_context(context, bagging, m, config.seed, index)
    drawn = drawn.withColumn("bag", F.col("bag").cast("bigint"))
    held = drawn.select("bag", F.col("slot").cast("bigint").alias("row_ord"), *features, target)
    cells, state, kind = fit_encoder(held, target, task, config, regression, classification, K.NUM_BINS, scale)
    asked = encode_queries(
        queries.select(index, *features), state, target, task, config, kind, index, chunk, regression, K.NUM_BINS
    )
    if task == "classification":
        schema = "row_ord bigint, bag bigint, label string, score double"
        scores = score_with_bags(cells, asked, scorer, schema)
        return O.combine_bags_auto(scores, ["row_ord"], bags, class_col="label")
    preds = score_with_bags(cells, asked, scorer, "row_ord bigint, bag bigint, pred double")
    marked = drawn.withColumn("is_query", F.lit(False))
    stats = E.scale_stats(marked, [target], ["bag"], "target").drop("col")
    scaled = O.unscale(preds.join(F.broadcast(stats), "bag"))  # stats: one short row per bag
    return O.combine_bags_reg(scaled, ["row_ord"])


def predict_table(context, queries, target, task, **options):
    """Predictions from plain feature columns by the built-in scorer; see ``predict_with_scorer``.

    Classification: (row_ord, label, prob, pred), pred being the most probable label, the first one on
    a tie. Regression: (row_ord, pred).
    """
    if task == "regression":
        return predict_with_scorer(context, queries, target, task, N.value_scorer, **options)
    probs = predict_with_scorer(context, queries, target, task, N.class_scorer, **options)
    best = F.min_by("label", F.struct(-F.col("prob"), "label")).over(W.partitionBy("row_ord"))
    return probs.withColumn("pred", best)
