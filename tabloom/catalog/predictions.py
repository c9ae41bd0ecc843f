"""Queries on similarity, scores, bags, predictions and metrics."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.draws import draw

from ..operators import metrics as R
from ..operators import sampling as S
from ..operators import scores as O
from ..operators import similarity as M
from ..operators import text as X
from ..plans import predict as PR
from ..plans.prepare import SampleConfig
from .registry import SEED, big, chunked, query, rounded, sql_chunked, sql_draw, table

B = 125
KEYS = ["table_id", "chunk_id"]


def split_vectors(spark, d):
    """Embeddings in chunks, shuffled, four fifths of each as context."""
    rows = chunked(spark, d, "embeddings", "vec_id", B)
    # One small file is one input partition; spread it before the numeric work.
    rows = rows.repartition(*KEYS)
    return S.split_context(S.order_rows(rows, SEED, KEYS, shuffle=True), fit_size=0.8)


VEC = "embedding::double[]"
SPLIT = f"""select *, pos > floor(n * 0.8::double)::bigint as is_query from (
    select *, row_number() over (partition by chunk_id order by {sql_draw("row_order", "table_id", "chunk_id", "row_ord")}, row_ord) as pos,
      count(*) over (partition by chunk_id) as n from (
      select *, 'embeddings' as table_id, vec_id as row_ord, vec_id // {B} as chunk_id, {VEC} as v from embeddings))"""
PAIRS = f"""select q.chunk_id, q.vec_id, c.vec_id as ctx, c.label, list_cosine_similarity(q.v, c.v) as cos, list_dot_product(q.v, c.v) as dot
    from ({SPLIT}) q join ({SPLIT}) c on q.chunk_id = c.chunk_id and q.is_query and not c.is_query"""


@query(
    "query_context_pairs",
    f"select vec_id, count(*) as n_context, arg_max(ctx, cos) as nearest, round(max(cos), 6) as sim from ({PAIRS}) group by 1",
)
def query_context_pairs(spark, d):
    out = M.nearest_context(split_vectors(spark, d), KEYS, "vec_id", "embedding")
    return out.select("vec_id", "n_context", "nearest", rounded("sim"))


@query(
    "class_max_similarity",
    f"select vec_id, label::bigint as code, round(max(1 / (1 + exp(-dot))), 6) as sim from ({PAIRS}) group by 1, 2",
)
def class_max_similarity(spark, d):
    out = M.class_similarity(split_vectors(spark, d), KEYS, "vec_id", "embedding", "label", "dot")
    return out.select("vec_id", "code", rounded("sim"))


SQL_LOGIT = lambda p: f"ln(least(greatest({p}, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest({p}, 1e-6), 1 - 1e-6))"
BEST = f"select vec_id, label, max(cos) as sim from ({PAIRS}) group by 1, 2"


@query(
    "similarity_classify",
    f"""select vec_id, arg_min(label, (-sim, label))::bigint as pred, round(max({SQL_LOGIT('sim')}), 5) as pred_score
        from ({BEST}) group by 1""",
)
def similarity_classify(spark, d):
    best = M.class_similarity(split_vectors(spark, d), KEYS, "vec_id", "embedding", "label")
    scored = best.withColumn("score", V.clipped_logit("sim"))
    # Decide on the similarity: clipping the logit may tie classes.
    top = O.argmax(scored, ["vec_id"], "code", "sim").drop("pred_score")
    high = scored.groupBy("vec_id").agg(F.round(F.max("score"), 5).alias("pred_score"))
    return top.join(high, "vec_id").select("vec_id", big("pred"), "pred_score")


def consecutive(spark, d):
    """Each vector with the next one: a given list of pairs, linear in the table."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


NEXT = f"select a.vec_id, a.{VEC} as a, b.{VEC} as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"


@query("cosine_similarity", f"select vec_id, round(list_cosine_similarity(a, b), 6) as sim from ({NEXT})")
def cosine_similarity(spark, d):
    return consecutive(spark, d).select("vec_id", F.round(V.cosine("a", "b"), 6).alias("sim"))


@query("dot_similarity", f"select vec_id, round(list_dot_product(a, b), 6) as sim from ({NEXT})")
def dot_similarity(spark, d):
    return consecutive(spark, d).select("vec_id", F.round(V.dot("a", "b"), 6).alias("sim"))


@query(
    "symmetrise",
    """select f.table_id, f.i, f.j, round((f.sim + t.sim) / 2, 6) as sim from (
       select 'embeddings' as table_id, vec_id as i, vec_id + k - 3 as j, embedding[k + 1]::double as sim
         from embeddings, range(7) r(k)) f
       join (select vec_id as i, vec_id + k - 3 as j, embedding[k + 1]::double as sim from embeddings, range(7) r(k)) t
       on f.i = t.j and f.j = t.i""",
)
def symmetrise(spark, d):
    # A banded row x row table: entry (i, i+k-3) is one component of vector i.
    rows = table(spark, d, "embeddings")
    n = rows.agg(F.max("vec_id")).scalar()
    band = rows.select(
        F.lit("embeddings").alias("table_id"),
        F.col("vec_id").alias("i"),
        F.posexplode(F.slice("embedding", 1, 7)).alias("k", "sim"),
    ).select("table_id", "i", (F.col("i") + F.col("k") - 3).alias("j"), F.col("sim").cast("double"))
    band = band.where((F.col("j") >= 0) & (F.col("j") <= n))
    return M.symmetrise(band, ["table_id"]).select("table_id", "i", "j", rounded("sim"))


# ---- scores -------------------------------------------------------------------------------

BAGS, CLASSES = 3, 10
SCORES = f"""select vec_id as q, bag, k, 'c' || k as class, label, embedding[bag * 10 + k + 1]::double * 4 as score
    from embeddings, range({BAGS}) b(bag), range({CLASSES}) c(k) where not (bag = 2 and k = 9)"""


def scores(spark, d):
    """Three bags of ten class scores per row, taken from its vector; bag 2 lacks class c9."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("q"), "label", F.posexplode(F.slice("embedding", 1, BAGS * CLASSES)).alias("p", "x")
    )
    bag, k = F.floor(F.col("p") / CLASSES).cast("int"), F.col("p") % CLASSES
    out = rows.select(
        "q", "label", bag.alias("bag"), k.alias("k"),
        F.concat(F.lit("c"), k.cast("string")).alias("class"), (F.col("x").cast("double") * 4).alias("score"),
    )
    return out.where(~((F.col("bag") == 2) & (F.col("k") == 9)))


@query(
    "align_classes",
    f"""select q, bag, class, coalesce(round(s.score, 6), '-Infinity'::double) as score
        from (select distinct q, bag from ({SCORES})) r cross join (select distinct class from ({SCORES})) c
        left join ({SCORES}) s using (q, bag, class)""",
)
def align_classes(spark, d):
    out = scores(spark, d)
    full = O.align_classes(out, out.select("class"), ["q", "bag"])
    inf = F.col("score") == F.lit(float("-inf"))
    return full.select(
        "q", big("bag"), "class", F.when(inf, F.col("score")).otherwise(F.round("score", 6)).alias("score")
    )


PROB = f"select q, bag, k, class, label, score, exp(score) / sum(exp(score)) over (partition by q, bag) as p from ({SCORES})"


@query("softmax_scores", f"select q, bag::bigint as bag, class, round(p, 6) as prob from ({PROB})")
def softmax_scores(spark, d):
    return O.softmax(scores(spark, d), ["q", "bag"]).select("q", big("bag"), "class", rounded("prob"))


@query(
    "logit_scores",
    f"select q, bag, class, round({SQL_LOGIT('score')}, 5) as logit from ({SCORES})",
)
def logit_scores(spark, d):
    return scores(spark, d).select("q", big("bag"), "class", F.round(V.clipped_logit("score"), 5).alias("logit"))


@query(
    "probability_check",
    f"""select bag, bool_and(lo >= -1e-4 and hi <= 1 + 1e-4 and abs(s - 1) <= 2e-4) as is_probability from (
        select bag, q, min(x) as lo, max(x) as hi, sum(x) as s from (
          select bag, q, case when bag = 0 then p when bag = 1 then p * 1.001 else score end as x from ({PROB}))
        group by 1, 2) group by 1""",
)
def probability_check(spark, d):
    probs = O.softmax(scores(spark, d), ["q", "bag"])
    mixed = F.when(F.col("bag") == 0, F.col("prob")).when(F.col("bag") == 1, F.col("prob") * 1.001)
    used = probs.withColumn("x", mixed.otherwise(F.col("score")))
    return O.looks_like_probabilities(used, ["bag"], ["q"], "x").select(big("bag"), "is_probability")


@query(
    "combine_bags_cls",
    f"""select 'logit' as mode, q, class, round(sum(p) / 3, 6) as prob from ({PROB}) group by 2, 3
        union all select 'probability', q, class, round(sum(p) / 3, 6) from ({PROB}) group by 2, 3
        union all select 'similarity', q, class, round(exp(s) / sum(exp(s)) over (partition by q), 6) from (
          select q, class, max(score) as s from ({SCORES}) group by 1, 2)""",
)
def combine_bags_cls(spark, d):
    raw = scores(spark, d)
    probs = O.softmax(raw, ["q", "bag"])
    parts = [
        O.combine_bags_auto(raw, ["q"], BAGS).withColumn("mode", F.lit("logit")),
        O.combine_bags_auto(probs, ["q"], BAGS, score="prob").withColumn("mode", F.lit("probability")),
        O.combine_bags_cls(raw, ["q"], BAGS, "similarity").withColumn("mode", F.lit("similarity")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("mode", "q", "class", rounded("prob"))


@query("predict_class", f"select q, bag::bigint as bag, arg_min(class, (-score, class)) as pred from ({SCORES}) group by 1, 2")
def predict_class(spark, d):
    return O.argmax(scores(spark, d), ["q", "bag"]).select("q", big("bag"), "pred")


@query("expected_value", f"select q, bag::bigint as bag, round(sum(p * (k + 0.5)), 6) as pred from ({PROB}) group by 1, 2")
def expected_value(spark, d):
    valued = scores(spark, d).withColumn("quantile", F.col("k") + 0.5)
    return O.expected_value(valued, ["q", "bag"]).select("q", big("bag"), rounded("pred"))


@query(
    "combine_bags_reg",
    f"select q, round(avg(v), 6) as pred from (select q, bag, sum(p * (k + 0.5)) as v from ({PROB}) group by 1, 2) group by 1",
)
def combine_bags_reg(spark, d):
    valued = scores(spark, d).withColumn("quantile", F.col("k") + 0.5)
    per_bag = O.expected_value(valued, ["q", "bag"])
    return O.combine_bags_reg(per_bag, ["q"]).select("q", rounded("pred"))


@query(
    "mean_pool",
    """select text_id, d - 1 as dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) as mean,
       round(arg_min(x, vec_id), 6) as first from (
       select vec_id // 16 as text_id, vec_id, (vec_id % 5 <> 0)::int::double as m,
         unnest(range(1, 65)) as d, unnest(embedding)::double as x from embeddings) group by 1, 2""",
)
def mean_pool(spark, d):
    # Runs of 16 vectors stand for the token vectors of one text; every fifth token is masked.
    tokens = table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 16).cast("bigint").alias("text_id"),
        F.col("vec_id").alias("pos"),
        (F.col("vec_id") % 5 != 0).alias("mask"),
        F.col("embedding").alias("vec"),
    )
    mean, first = X.pool(tokens, ["text_id"]), X.pool(tokens, ["text_id"], "cls")
    both = mean.join(first.withColumnRenamed("vec", "first"), "text_id")
    each = both.select("text_id", F.posexplode(F.arrays_zip("vec", "first")).alias("dim", "x"))
    return each.select(
        "text_id", big("dim"), F.round("x.vec", 6).alias("mean"), F.round(F.col("x.first").cast("double"), 6).alias("first")
    )


# ---- metrics ------------------------------------------------------------------------------


def query_scores(spark, d):
    """Bag 0 scores of query rows with their label as truth."""
    marks = split_vectors(spark, d).where("is_query").select("chunk_id", F.col("vec_id").alias("q"))
    return scores(spark, d).where("bag = 0").withColumnRenamed("label", "truth").join(marks, "q")


QSCORES = f"""select s.chunk_id, p.* from ({PROB}) p join (select vec_id, chunk_id from ({SPLIT}) where is_query) s
    on p.q = s.vec_id where bag = 0"""
PREDS = f"select chunk_id, q, any_value(label) as truth, arg_min(k, (-score, k)) as pred from ({QSCORES}) group by 1, 2"


@query(
    "metric_log_loss",
    f"select chunk_id, round(avg(-ln(p)), 6) as log_loss from ({QSCORES}) where k = label group by 1",
)
def metric_log_loss(spark, d):
    out = R.log_loss(query_scores(spark, d), ["chunk_id"], "q", class_col="k")
    return out.select("chunk_id", rounded("log_loss"))


@query(
    "metric_accuracy",
    f"select chunk_id, round(avg((pred = truth)::int), 6) as accuracy from ({PREDS}) group by 1",
)
def metric_accuracy(spark, d):
    best = query_scores(spark, d).groupBy("chunk_id", "q", "truth").agg(
        F.min_by("k", F.struct((-F.col("score")).alias("s"), F.col("k").alias("k2"))).alias("pred")
    )
    return R.accuracy(best, ["chunk_id"]).select("chunk_id", rounded("accuracy"))


@query(
    "metric_baseline_lift",
    f"""select chunk_id, round(acc, 6) as acc, round(base_acc, 6) as base_acc,
        round(least(greatest((acc - base_acc) / (1 - base_acc + 1e-5), 0), 1), 6) as lift from (
        select p.chunk_id, avg((p.pred = p.truth)::int) as acc, avg((b.label = p.truth)::int) as base_acc from ({PREDS}) p
        join (select chunk_id, arg_min(label, (-n, label)) as label from (
          select chunk_id, label, count(*) as n from ({SPLIT}) where not is_query group by 1, 2) group by 1) b
        using (chunk_id) group by 1)""",
)
def metric_baseline_lift(spark, d):
    best = O.argmax(scores(spark, d).where("bag = 0"), ["q"], "k").drop("pred_score")
    rows = split_vectors(spark, d).select(
        "chunk_id", "is_query", F.col("vec_id").alias("q"), F.col("label").alias("truth")
    )
    out = R.baseline_lift(rows.join(best, "q"), ["chunk_id"])
    return out.select("chunk_id", rounded("acc"), rounded("base_acc"), rounded("lift"))


def guesses(spark, d):
    """Query rows with a numeric truth and a guess that is sometimes not finite."""
    rows = split_vectors(spark, d).where("is_query")
    guess = F.when(F.col("vec_id") % 17 == 0, F.lit(float("inf"))).otherwise(F.col("embedding")[1].cast("double") * 10)
    return rows.select("chunk_id", (F.col("embedding")[0].cast("double") * 8).alias("truth"), guess.alias("pred"))


GUESSES = f"""select chunk_id, v[1] * 8 as truth, case when vec_id % 17 = 0 then 0 else v[2] * 10 end as pred
    from ({SPLIT}) where is_query"""


@query(
    "metric_mse",
    f"select chunk_id, round(least(avg((pred - truth) ** 2), 10), 6) as mse from ({GUESSES}) group by 1",
)
def metric_mse(spark, d):
    return R.mse_clipped(guesses(spark, d), ["chunk_id"]).select("chunk_id", rounded("mse"))


@query(
    "metric_r2",
    f"""select chunk_id, round(greatest(least(1 - sum((pred - truth) ** 2) / (var_pop(truth) * count(*)), 1), -1), 6) as r2
        from ({GUESSES}) group by 1""",
)
def metric_r2(spark, d):
    return R.r2_clipped(guesses(spark, d), ["chunk_id"]).select("chunk_id", rounded("r2"))


ALL_PAIRS = f"""select a.chunk_id, a.label = b.label as same, not a.is_query and b.is_query as crossing,
    list_cosine_similarity(a.v, b.v) as cos, list_dot_product(a.v, b.v) as dot
    from ({SPLIT}) a join ({SPLIT}) b using (chunk_id)"""
CLIPPED = "least(greatest(cos, 1e-7), 1 - 1e-7)"
COS_LOSS = f"-case when same then ln({CLIPPED}) else ln(1 - {CLIPPED}) end"
DOT_LOSS = "greatest(dot, 0) - dot * same::int + ln(1 + exp(-abs(dot)))"


def _pair_variants(spark, d):
    rows = split_vectors(spark, d)
    for name, kind, crossing in (("cosine", "cosine", False), ("dot", "dot", False), ("crossing", "dot", True)):
        yield name, M.pair_sums(rows, KEYS, "vec_id", "embedding", "label", kind, crossing)


@query(
    "metric_pair_loss",
    f"""select chunk_id, 'cosine' as kind, round(3 * avg({COS_LOSS}), 5) as pair_loss from ({ALL_PAIRS}) group by 1
        union all select chunk_id, 'dot', round(3 * avg({DOT_LOSS}), 5) from ({ALL_PAIRS}) group by 1
        union all select chunk_id, 'crossing', round(3 * avg({DOT_LOSS}), 5) from ({ALL_PAIRS}) where crossing group by 1""",
)
def metric_pair_loss(spark, d):
    parts = [
        M.pair_log_loss(sums, ["chunk_id"]).withColumn("kind", F.lit(name))
        for name, sums in _pair_variants(spark, d)
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("chunk_id", "kind", rounded("pair_loss", 5))


@query(
    "metric_pair_jaccard",
    f"""select chunk_id, 'cosine' as kind, round(count(*) filter (same and cos > 0.5) / count(*) filter (same or cos > 0.5), 6) as pair_jaccard
          from ({ALL_PAIRS}) group by 1
        union all select chunk_id, 'dot', round(count(*) filter (same and dot > 0) / count(*) filter (same or dot > 0), 6)
          from ({ALL_PAIRS}) group by 1""",
)
def metric_pair_jaccard(spark, d):
    parts = [
        M.pair_jaccard(sums, ["chunk_id"]).withColumn("kind", F.lit(name))
        for name, sums in _pair_variants(spark, d)
        if name != "crossing"
    ]
    return parts[0].unionByName(parts[1]).select("chunk_id", "kind", rounded("pair_jaccard"))


# ---- prediction jobs ----------------------------------------------------------------------

M_ROWS, N_BAGS = 256, 4


def context_and_queries(spark, d):
    """The embeddings table cut in two by a draw; context rows get a dense index."""
    rows = table(spark, d, "embeddings").withColumn("table_id", F.lit("embeddings"))
    is_query = draw(SEED, "holdout", "vec_id") % 5 == 0
    context = S.dense_index(rows.where(~is_query), ["table_id"], "vec_id", "row_ord")
    return context, rows.where(is_query)


HELD = f"select vec_id, label, {VEC} as v, {sql_draw('holdout', 'vec_id')} % 5 = 0 as is_query from embeddings"
CTX = f"select *, row_number() over (order by vec_id) - 1 as idx from ({HELD}) where not is_query"
DRAWN = f"""select bag, c.* from (select bag, {sql_draw("bootstrap", "'predict'", "bag", "slot")} % (select count(*) from ({CTX})) as idx
    from range({N_BAGS}) b(bag), range({M_ROWS}) s(slot)) join ({CTX}) c using (idx)"""


def sql_proba(held=HELD):
    """Every class of the context table has a row, also one that no bag drew; queries without a vector have
    null probabilities."""
    ctx, drawn = (x.replace(HELD, held) for x in (CTX, DRAWN))
    best = f"""select q.vec_id, c.bag, c.label, max(list_cosine_similarity(q.v, c.v)) as sim
        from ({held}) q join (select distinct * from ({drawn})) c on q.is_query and q.v is not null group by 1, 2, 3"""
    proba = f"""select vec_id, label, exp(s) / sum(exp(s)) over (partition by vec_id) as p from (
        select vec_id, label, max({SQL_LOGIT('sim')}) as s from ({best}) group by 1, 2)"""
    return f"""select vec_id, label, case when v is not null then coalesce(p, 0) end as p
        from (select vec_id, v from ({held}) where is_query) cross join (select distinct label from ({ctx}))
        left join ({proba}) using (vec_id, label)"""


PROBA = sql_proba()
# Rare classes, most of them in no bag, and queries without a vector.
GAPPY = HELD.replace("label", "case when vec_id % 50 = 1 then 1000 + vec_id else label end as label", 1).replace(
    f"{VEC} as v", f"case when vec_id % 55 <> 0 or {sql_draw('holdout', 'vec_id')} % 5 <> 0 then {VEC} end as v"
)


def gappy(spark, d):
    context, queries = context_and_queries(spark, d)
    rare = F.when(F.col("vec_id") % 50 == 1, 1000 + F.col("vec_id")).otherwise(F.col("label").cast("bigint"))
    return context.withColumn("label", rare), queries.withColumn("embedding", F.when(F.col("vec_id") % 55 != 0, F.col("embedding")))


@query("predict_proba_gappy", f"select vec_id, label::bigint as class, round(p, 6) as prob from ({sql_proba(GAPPY)})")
def predict_proba_gappy(spark, d):
    context, queries = gappy(spark, d)
    out = PR.predict_proba(context, queries, "vec_id", "embedding", "label", N_BAGS, M_ROWS, SEED)
    return out.select("vec_id", big("class"), rounded("prob"))


@query(
    "predict_class_gappy",
    f"""select vec_id, case when count(p) > 0 then arg_min(label, (-p, label)) end::bigint as pred
        from ({sql_proba(GAPPY)}) group by 1""",
)
def predict_class_gappy(spark, d):
    context, queries = gappy(spark, d)
    out = PR.predict_class(
        context, queries, "vec_id", "embedding", "label", bagging=N_BAGS, m=M_ROWS, seed=SEED
    )
    return out.select("vec_id", big("pred"))


@query("predict_proba_bagged", f"select vec_id, label::bigint as class, round(p, 6) as prob from ({PROBA})")
def predict_proba_bagged(spark, d):
    context, queries = context_and_queries(spark, d)
    out = PR.predict_proba(context, queries, "vec_id", "embedding", "label", N_BAGS, M_ROWS, SEED)
    return out.select("vec_id", big("class"), rounded("prob"))


@query("predict_class_bagged", f"select vec_id, arg_min(label, (-p, label))::bigint as pred from ({PROBA}) group by 1")
def predict_class_bagged(spark, d):
    context, queries = context_and_queries(spark, d)
    out = PR.predict_class(
        context, queries, "vec_id", "embedding", "label", bagging=N_BAGS, m=M_ROWS, seed=SEED
    )
    return out.select("vec_id", big("pred"))


def _value_check():
    from .samples import sql_bins, sql_edges

    source = f"select bag, vec_id, v, label::double as y, false as is_query from ({DRAWN})"
    binned = f"select distinct bag, vec_id, v, bin_code::bigint as k from ({sql_bins(source, 'y', group='bag')})"
    best = f"""select q.vec_id, c.bag, c.k, max(list_cosine_similarity(q.v, c.v)) as sim
        from ({HELD}) q join ({binned}) c on q.is_query group by 1, 2, 3"""
    logits = f"""select h.vec_id, b.bag, k.k, {SQL_LOGIT("coalesce(x.sim, 0)")} as s, e.edges[k.k + 2] as quantile
        from (select vec_id from ({HELD}) where is_query) h cross join range({N_BAGS}) b(bag) cross join range(16) k(k)
        left join ({best}) x on x.vec_id = h.vec_id and x.bag = b.bag and x.k = k.k
        join ({sql_edges(source, "y", group="bag")}) e on e.bag = b.bag"""
    return f"""select vec_id, round(avg(value), 6) as pred from (
        select vec_id, bag, sum(exp(s) * quantile) / sum(exp(s)) as value from ({logits}) group by 1, 2) group by 1"""


@query("predict_value_bagged", _value_check)
def predict_value_bagged(spark, d):
    context, queries = context_and_queries(spark, d)
    out = PR.predict_value(
        context, queries, "vec_id", "embedding", "label", N_BAGS, M_ROWS, SEED, scale=9
    )
    return out.select("vec_id", rounded("pred"))


def centroid_scorer(group):
    """A user scorer: dot product with the mean context vector of each class."""
    ctx, qry = group[~group["is_query"]], group[group["is_query"]]
    means = {k: np.mean(np.stack(g["embedding"]).astype(float), axis=0) for k, g in ctx.groupby("label")}
    rows = [
        (vec_id, int(k), float(np.dot(np.asarray(v, float), m)))
        for vec_id, v in zip(qry["vec_id"], qry["embedding"])
        for k, m in means.items()
    ]
    return pd.DataFrame(rows, columns=["vec_id", "code", "score"])


@query(
    "score_hook",
    f"select vec_id, label::bigint as code, round(avg(dot), 6) as score from ({PAIRS}) group by 1, 2",
)
def score_hook(spark, d):
    samples = split_vectors(spark, d).select(*KEYS, "vec_id", "embedding", "label", "is_query")
    out = M.score_hook(samples, KEYS, centroid_scorer, "vec_id bigint, code bigint, score double")
    return out.select("vec_id", "code", rounded("score"))


PARTS = f"select p_partkey, p_brand, p_type, p_size::varchar as p_size, {sql_draw('holdout', 'p_partkey')} % 5 = 0 as is_query from part"
PART_CONTEXT = f"select *, row_number() over (order by p_partkey) - 1 as idx from ({PARTS}) where not is_query"
PART_BAGS = f"""select bag, c.* from (select bag, {sql_draw("bootstrap", "'predict'", "bag", "slot")} % (select count(*) from ({PART_CONTEXT})) as idx
    from range({N_BAGS}) b(bag), range({M_ROWS}) s(slot)) join ({PART_CONTEXT}) c using (idx)"""
PART_BEST = f"""select row_ord, bag, label, least(greatest(sim, 1e-6), 1 - 1e-6) as p from (
    select q.row_ord, c.bag, c.p_brand as label, max(((q.p_type = c.p_type)::int + (q.p_size = c.p_size)::int) / 2) as sim
    from (select *, row_number() over (order by p_partkey) - 1 as row_ord from ({PARTS}) where is_query) q, ({PART_BAGS}) c group by 1, 2, 3)"""


@query(
    "predict_table",
    f"""select row_ord, label, round(sum(prob) / {N_BAGS}, 6) as prob from (
        select *, exp(ln(p) - ln(1 - p)) / sum(exp(ln(p) - ln(1 - p))) over (partition by row_ord, bag) as prob from ({PART_BEST}))
        group by 1, 2""",
)
def predict_table(spark, d):
    """The brand of a fifth of the parts from type and size of the others, without any vectors."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").cast("string").alias("p_size"), "p_brand")
    rows = rows.withColumn("table_id", F.lit("part"))
    is_query = draw(SEED, "holdout", "p_partkey") % 5 == 0
    context, queries = (S.dense_index(rows.where(x), ["table_id"], "p_partkey", "row_ord") for x in (~is_query, is_query))
    shown = ("row_ord", "p_type", "p_size")
    out = PR.predict_table(
        context.select(*shown, "p_brand"), queries.select(*shown), "p_brand", "classification",
        bagging=N_BAGS, m=M_ROWS, config=SampleConfig(seed=SEED),
    )
    return out.select(big("row_ord"), "label", rounded("prob"))
