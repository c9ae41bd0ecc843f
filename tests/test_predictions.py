"""Text dictionary, similarity, scores, metrics and prediction jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbours
from tabloom.functions import vectors as V
from tabloom.operators import metrics as M
from tabloom.operators import scores as O
from tabloom.operators import similarity as S
from tabloom.operators import text as X
from tabloom.operators import search as N
from tabloom.plans import fitted as FT
from tabloom.plans import predict as P
from tabloom.plans.prepare import SampleConfig

INF = float("inf")


def bags(spark):
    rows = [
        (0, 1, "a", 0.2), (0, 1, "b", 0.5), (0, 1, "c", 0.3),
        (1, 1, "a", 0.6), (1, 1, "b", 0.4),
    ]
    return spark.createDataFrame(rows, "bag int, q long, class string, score double")


@pytest.mark.parametrize("fill", [None, 0.0])
def test_align(spark, fill):
    full = O.align_classes(bags(spark), bags(spark).select("class"), ["q", "bag"], fill=fill)
    got = {(r.bag, r["class"]): r.score for r in full.collect()}
    assert len(got) == 6 and got[1, "c"] == (-INF if fill is None else 0.0) and got[0, "b"] == 0.5


def test_combination_modes(spark):
    def probs(df):
        return {r["class"]: round(r.prob, 6) for r in df.collect()}

    mean = {"a": 0.4, "b": 0.45, "c": 0.15}
    assert probs(O.combine_bags_cls(bags(spark), ["q"], 2, "probability")) == mean
    assert probs(O.combine_bags_auto(bags(spark), ["q"], 2)) == mean
    off = bags(spark).withColumn("score", F.col("score") + 1)
    e0, e1 = np.exp([0.2, 0.5, 0.3]), np.exp([0.6, 0.4, -INF])
    soft = (e0 / e0.sum() + e1 / e1.sum()) / 2
    assert list(probs(O.combine_bags_auto(off, ["q"], 2)).values()) != list(mean.values())
    got = probs(O.combine_bags_auto(off, ["q"], 2))
    assert [got[c] for c in "abc"] == pytest.approx(soft, abs=1e-6)
    best = np.exp([0.6, 0.5, 0.3])
    got = probs(O.combine_bags_cls(bags(spark), ["q"], 2, "similarity"))
    assert [got[c] for c in "abc"] == pytest.approx(best / best.sum(), abs=1e-6)
    with pytest.raises(ValueError):
        O.combine_bags_cls(bags(spark), ["q"], 0, "logit")


def test_probability_detector(spark):
    rows = [("ok", 1, 0.5), ("ok", 1, 0.5), ("off", 1, 0.5), ("off", 1, 0.5003), ("neg", 1, -0.1), ("neg", 1, 1.1)]
    df = spark.createDataFrame(rows, "k string, q int, score double")
    got = {r.k: r.is_probability for r in O.looks_like_probabilities(df, ["k"], ["q"]).collect()}
    assert got == {"ok": True, "off": False, "neg": False}


def test_argmax_tie_goes_to_the_first_class(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0)], "q int, class string, score double")
    assert O.argmax(df, ["q"]).first().pred == "a"


def test_logit_and_softmax_expressions(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (-INF,), (float("nan"),), (None,)], "p double")
    got = [r[0] for r in df.select(V.clipped_logit("p")).collect()]
    edge = np.log(1e-6) - np.log1p(-1e-6)
    assert got == pytest.approx([0.0, edge, -edge, edge, -1e4, -1e4])
    arr = spark.createDataFrame([([1.0, None, 3.0],)], "a array<double>").select(V.softmax_array(F.col("a"))).first()[0]
    e = np.exp([1.0, -INF, 3.0])
    assert arr == pytest.approx(e / e.sum())


def vectors(spark, n=60, dims=5, seed=0, classes=4):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "sample": np.arange(n) // (n // 2), "row": np.arange(n), "vec": rng.normal(size=(n, dims)).tolist(),
        "code": rng.integers(0, classes, n), "is_query": rng.random(n) < 0.3,
    })
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("kind", ["cosine", "dot"])
def test_class_similarity_matches_brute_force(spark, kind):
    frame, df = vectors(spark)
    got = {(r["row"], r.code): r.sim for r in S.class_similarity(df, ["sample"], "row", "vec", "code", kind).collect()}
    want = {}
    for q in frame[frame.is_query].itertuples():
        for c in frame[~frame.is_query & (frame["sample"] == q.sample)].itertuples():
            a, b = np.array(q.vec), np.array(c.vec)
            sim = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if kind == "cosine" else 1 / (1 + np.exp(-a @ b))
            key = (q.row, c.code)
            want[key] = max(sim, want.get(key, -INF))
    assert got == pytest.approx(want)


def test_pair_metrics_match_brute_force(spark):
    frame, df = vectors(spark)
    sums = S.pair_sums(df, ["sample"], "row", "vec", "code", "dot")
    loss = {r["sample"]: r.pair_loss for r in S.pair_log_loss(sums, ["sample"]).collect()}
    share = {r["sample"]: r.pair_jaccard for r in S.pair_jaccard(sums, ["sample"]).collect()}
    for k, g in frame.groupby("sample"):
        m, y = np.stack(g["vec"]), g["code"].to_numpy()
        x, t = m @ m.T, y[:, None] == y[None, :]
        p = 1 / (1 + np.exp(-x))
        assert loss[k] == pytest.approx(3 * -(t * np.log(p) + ~t * np.log(1 - p)).mean())
        assert share[k] == pytest.approx((t & (p > 0.5)).sum() / (t | (p > 0.5)).sum())


def full_product(q, ctx, codes, n_codes, kind):
    out = np.full((len(q), n_codes), np.nan)
    unit = lambda m: m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), 1e-12))
    sims = unit(q) @ unit(ctx).T if kind == "cosine" else q @ ctx.T
    for c in set(codes):
        out[:, c] = sims[:, codes == c].max(axis=1)
    return out


@pytest.mark.parametrize("kind", ["cosine", "dot"])
def test_pivot_bounds_leave_out_blocks_and_change_nothing(kind):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6))
    ctx = np.concatenate([c + 0.02 * rng.normal(size=(60, 6)) for c in centres])
    ctx[5] = ctx[77] = 0  # vectors of no length
    codes = np.repeat(np.arange(40) % 4, 60)
    q = np.concatenate([ctx[::37] + 0.01 * rng.normal(size=(len(ctx[::37]), 6)), rng.normal(size=(50, 6)), np.zeros((2, 6)), 5 * ctx[:40]])
    blocks = []
    for c in range(4):
        rows = np.flatnonzero(codes == c)
        for part in N.cut_blocks(ctx[rows], 32):
            blocks.append((c, *N.bounds_of(ctx[rows][part]), ctx[rows][part]))
    assert max(len(b[5]) for b in blocks) <= 32 and sum(len(b[5]) for b in blocks) == len(ctx)
    best, products = N.best_by_class(q, blocks, 5, kind)
    np.testing.assert_allclose(best, full_product(q, ctx, codes, 5, kind), atol=1e-12)
    if kind == "cosine":
        assert products < 0.6 * len(q) * len(ctx)
    alone = N.best_by_class(q, [(0, *N.bounds_of(ctx), ctx)], 1, kind)[0]
    np.testing.assert_allclose(alone[:, 0], full_product(q, ctx, np.zeros(len(ctx), int), 1, kind)[:, 0], atol=1e-12)


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_bag_scores_on_gappy_input(spark, held):
    frame, df = vectors(spark, 80)
    context = df.where("not is_query").withColumn("bag", F.col("sample").cast("int"))
    context = context.unionByName(context.limit(3).withColumn("vec", F.lit(None).cast(context.schema["vec"].dataType)))
    context = context.unionByName(context.limit(3).withColumn("code", F.lit(None).cast(context.schema["code"].dataType)))
    queries = df.where("is_query").withColumn("vec", F.when(F.col("row") % 7 != 0, F.col("vec")))
    got = {(r["row"]): r.sims for r in N.bag_scores(queries, context, "row", "vec", "code", 5, 3, most=8, held_bytes=held).collect()}
    asked = frame[frame["is_query"]]
    assert len(got) == len(set(asked["row"])) and any(v is None for v in got.values())
    for row in asked.itertuples():
        if row.row % 7 == 0:
            assert got[row.row] is None
            continue
        want = []
        for bag in range(3):
            own = frame[~frame["is_query"] & (frame["sample"] == bag)]
            ctx = np.stack(own["vec"]) if len(own) else np.zeros((0, 5))
            want += list(full_product(np.array([row.vec]), ctx, own["code"].to_numpy(), 5, "cosine")[0])
        np.testing.assert_allclose([np.nan if x is None else x for x in got[row.row]], want, atol=1e-9)


def test_scores_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = [(q, b, c, 0.25 + 0.5 * (c == 1)) for q in range(20) for b in range(2) for c in range(2)]
    scores = spark.createDataFrame(rows, "q long, bag long, class long, score double").mapInArrow(made, "q long, bag long, class long, score double")
    got = O.combine_bags_auto(scores, ["q"], 2).toPandas()
    assert calls.value == len(rows)
    assert got.groupby("class")["prob"].first().tolist() == [0.25, 0.75]  # they look like probabilities
    one_off = scores.withColumn("score", F.when((F.col("q") == 3) & (F.col("bag") == 1), 5.0).otherwise(F.col("score")))
    got = O.combine_bags_auto(one_off, ["q"], 2).toPandas()
    assert got[(got["q"] == 0)]["prob"].round(6).tolist() != [0.25, 0.75] and got["prob"].sum() == pytest.approx(20)


def test_dictionary(spark):
    texts = ["Red car", "red CAR", "", "a b", None, "Red car", "été!"]
    cells = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, txt string")
    distinct = X.distinct_texts(cells)
    assert {r.txt for r in distinct.collect()} == set(texts) - {None}
    known = X.hash_embed(distinct.where("txt like '%car%'"))
    grown = X.extend_dictionary(known, distinct)
    assert grown.count() == 5 and grown.select("text_id").distinct().count() == 5
    got = {r.i: r.vec for r in X.attach_text(cells, grown).collect()}
    assert got[0] == got[1] == got[5] and got[4] is None and set(got[2]) == {0.0}
    assert np.linalg.norm(got[3]) == pytest.approx(1.0) and len(got) == len(texts)


def test_hot_text_is_joined_by_broadcast(spark):
    cells = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), "id")).alias("txt"), "id")
    out = X.attach_text(cells, X.hash_embed(X.distinct_texts(cells)))
    assert out.count() == 4000 and out.where("vec is null").count() == 0


def test_user_embedder_is_batched(spark):
    cells = spark.createDataFrame([(f"t{i}",) for i in range(10)], "txt string")

    def make():
        def embed(batch):
            assert len(batch) <= 3
            return [[float(t[1:]), 1.0] for t in batch]

        return embed

    got = X.embed_with(X.distinct_texts(cells), make, batch=3).collect()
    assert sorted(r.vec[0] for r in got) == list(range(10))


def test_label_disambiguation(spark):
    rows = [("t", 0, 0, "x", [1.0]), ("t", 0, 1, "y", [1.0]), ("t", 0, 2, "x", [1.0]), ("t", 1, 3, "x", [1.0]), ("t", 1, 4, "y", [2.0])]
    df = spark.createDataFrame(rows, "table_id string, chunk_id long, row_ord long, y string, vec array<double>")
    got = {(r.chunk_id, r.y): r.label_text for r in X.disambiguate_labels(df, "y", "vec").collect()}
    assert got == {(0, "x"): "0_x", (0, "y"): "1_y", (1, "x"): "x", (1, "y"): "y"}


def test_metrics(spark):
    rows = [(0, 0, 1.0, 1.0), (0, 1, 2.0, 2.5), (0, 2, 3.0, INF), (1, 3, 5.0, 5.0), (1, 4, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "k int, q int, truth double, pred double")
    mse = {r.k: r.mse for r in M.mse_clipped(df, ["k"]).collect()}
    assert mse == pytest.approx({0: (0.25 + 9) / 3, 1: 8.0})
    r2 = {r.k: r.r2 for r in M.r2_clipped(df, ["k"]).collect()}
    assert r2 == pytest.approx({0: -1.0, 1: 0.0})
    scores = spark.createDataFrame(
        [(0, 0, 0, 1.0, 1), (0, 0, 1, 2.0, 1), (0, 1, 0, 3.0, 7), (0, 1, 1, 0.0, 7)],
        "k int, q int, class_idx int, score double, truth int",
    )
    loss = M.log_loss(scores, ["k"], "q").first().log_loss
    assert loss == pytest.approx(np.log1p(np.exp(-1.0)) / 2)  # a truth outside the classes adds 0


@pytest.mark.parametrize("method", ["mean", "cls"])
def test_pooling(spark, method):
    rows = [(1, 0, [1.0, 2.0], True), (1, 1, [3.0, 6.0], True), (1, 2, [9.0, 9.0], False), (2, 0, [4.0, 4.0], False)]
    df = spark.createDataFrame(rows, "t int, pos int, vec array<double>, mask boolean")
    got = {r.t: r.vec for r in X.pool(df, ["t"], method).collect()}
    assert got == ({1: [2.0, 4.0], 2: [0.0, 0.0]} if method == "mean" else {1: [1.0, 2.0], 2: [4.0, 4.0]})


def tables(spark, n=120, n_query=45):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, n + n_query)
    frame = pd.DataFrame({
        "size": y * 10 + rng.normal(size=len(y)), "shade": [f"s{k}" for k in y], "fixed": "same",
        "label": [f"c{k}" for k in y], "value": y * 5.0,
        "vec": [[float(np.cos(k)), float(np.sin(k)), 0.1] for k in y],
    })
    context = frame.iloc[:n].assign(row_ord=np.arange(n))
    queries = frame.iloc[n:].assign(row_ord=np.arange(n_query))
    return frame, spark.createDataFrame(context), spark.createDataFrame(queries)


@pytest.mark.parametrize("bagging,m", [(4, 50), (1, 60), ("auto", 50), ("auto", 500)])
def test_vector_predictions(spark, bagging, m):
    frame, context, queries = tables(spark)
    truth = frame.iloc[120:].reset_index(drop=True)
    probs = P.predict_proba(context, queries, "row_ord", "vec", "label", bagging, m).toPandas()
    assert probs.groupby("row_ord")["prob"].sum().to_numpy() == pytest.approx(1.0)
    preds = P.predict_class(context, queries, "row_ord", "vec", "label", bagging=bagging, m=m).toPandas()
    assert preds.set_index("row_ord")["pred"].sort_index().tolist() == truth["label"].tolist()
    values = P.predict_value(context, queries, "row_ord", "vec", "value", bagging, m).toPandas()
    values = values.set_index("row_ord")["pred"].sort_index()
    assert np.corrcoef(values, truth["value"])[0, 1] > 0.9


def test_arrays_hold_the_classes_of_the_bags_only(spark, monkeypatch):
    """Most classes are in no bag: they have a row of probability 0, or null without a vector, and no place."""
    _, context, queries = tables(spark)
    context = context.withColumn("label", F.when(F.col("row_ord") % 2 == 1, F.concat(F.lit("rare"), "row_ord")).otherwise(F.col("label")))
    queries = queries.withColumn("vec", F.when(F.col("row_ord") > 4, F.col("vec")))
    seen, scored = [], P.bag_scores
    monkeypatch.setattr(P, "bag_scores", lambda *a: seen.append(a[5:7]) or scored(*a))
    probs = P.predict_proba(context, queries, "row_ord", "vec", "label", 2, 10, 7).toPandas()
    preds = P.predict_class(context, queries, "row_ord", "vec", "label", bagging=2, m=10, seed=7).toPandas()
    assert len(seen) == 2 and all(n <= 20 and bags == 2 for n, bags in seen)
    assert len(probs) == 45 * 63 and not probs.duplicated(["row_ord", "class"]).any()
    assert probs["prob"].isna().equals(probs["row_ord"] <= 4)
    assert (probs["prob"] == 0).sum() >= 40 * (63 - 20)
    given = probs[probs["row_ord"] > 4]
    assert given.groupby("row_ord")["prob"].sum().to_numpy() == pytest.approx(1.0)
    best = given.sort_values(["prob", "class"], ascending=[False, True]).groupby("row_ord")["class"].first()
    got = preds.set_index("row_ord")["pred"].sort_index()
    assert got[got.index > 4].tolist() == best.tolist() and got[got.index <= 4].isna().all() and len(got) == 45


def test_similarities_are_given_out_in_parts(spark, monkeypatch):
    _, df = vectors(spark, 80)
    context = df.where("not is_query").withColumn("bag", F.col("sample").cast("int"))
    queries = df.where("is_query").withColumn("vec", F.when(F.col("row") % 7 != 0, F.col("vec"))).coalesce(1)
    ask = lambda: N.bag_scores(queries, context, "row", "vec", "code", 5, 3)
    whole = sorted(map(str, ask().collect()))
    monkeypatch.setattr(N, "OUT_BYTES", 1000)  # eight rows of fifteen numbers
    sizes = ask().mapInArrow(lambda batches: batches, "row long, sims array<double>")
    assert sorted(map(str, sizes.collect())) == whole


def scorers():
    """Two user scorers, local functions so that they travel to the workers by value."""

    def vote(group):
        """Scores a label by the share of context rows with the query row's shade."""
        cells = group[group["col"] == "shade"]
        ctx, qry = cells[~cells["is_query"]], cells[cells["is_query"]]
        assert not (group["col"] == "fixed").any() and qry["target_text"].isna().all()
        out = []
        for q in qry.itertuples():
            same = ctx[ctx["txt"] == q.txt]["target_text"].value_counts(normalize=True)
            out += [(q.row_ord, q.bag, label, share) for label, share in same.items()]
        return pd.DataFrame(out, columns=["row_ord", "bag", "label", "score"])

    def nearest(group):
        cells = group[group["col"] == "size"]
        ctx, qry = cells[~cells["is_query"]], cells[cells["is_query"]]
        at = [int((ctx["z"] - z).abs().to_numpy().argmin()) for z in qry["z"]]
        return pd.DataFrame({"row_ord": qry["row_ord"], "bag": qry["bag"], "pred": ctx["target"].to_numpy()[at]})

    return vote, nearest


def test_scorer_predictions(spark):
    vote, nearest = scorers()
    frame, context, queries = tables(spark)
    truth = frame.iloc[120:].reset_index(drop=True)
    keep = ["row_ord", "size", "shade", "fixed"]
    labels = P.predict_with_scorer(
        context.select(*keep, "label"), queries.select(*keep), "label", "classification", vote, bagging=3, m=40, chunk=20
    ).toPandas()
    assert len(labels) == 45 and labels["prob"].to_numpy() == pytest.approx(1.0)
    assert labels.set_index("row_ord")["label"].sort_index().tolist() == truth["label"].tolist()
    values = P.predict_with_scorer(
        context.select(*keep, "value"), queries.select(*keep), "value", "regression", nearest, bagging=3, m=40, chunk=20
    ).toPandas()
    assert values.set_index("row_ord")["pred"].sort_index().to_numpy() == pytest.approx(truth["value"].to_numpy(), abs=1e-6)


def test_built_in_scorer_on_plain_columns(spark):
    frame, context, queries = tables(spark)
    truth = frame.iloc[120:].reset_index(drop=True)
    keep = ["row_ord", "size", "shade", "fixed"]
    for regression in ("l2", "bins"):
        got = P.predict_table(
            context.select(*keep, "label"), queries.select(*keep), "label", "classification", bagging=3, m=40, chunk=20, regression=regression
        ).toPandas()
        assert got.groupby("row_ord")["prob"].sum().to_numpy() == pytest.approx(1.0) and got["row_ord"].nunique() == 45
        first = got.drop_duplicates("row_ord").set_index("row_ord")["pred"].sort_index()
        assert first.tolist() == truth["label"].tolist()
    values = P.predict_table(context.select(*keep, "value"), queries.select(*keep), "value", "regression", bagging=3, m=40, chunk=20).toPandas()
    assert values.set_index("row_ord")["pred"].sort_index().to_numpy() == pytest.approx(truth["value"].to_numpy(), abs=1.5)


def test_row_similarity_against_brute_force():
    rng = np.random.default_rng(5)
    rows = [(bool(i >= 30), i if i < 30 else i - 30, rng.choice(["a", "b", "None"]), float(rng.normal()), int(rng.integers(0, 20)), int(rng.integers(1, 13)), int(rng.integers(1, 29))) for i in range(50)]
    cells = []
    for is_query, row, text, z, y, m, d in rows:
        base = dict(bag=0, is_query=is_query, row_ord=row, target=-100.0 if is_query else row * 0.5, target_text=None if is_query else text, floor=-100.0, delta=0.0, z=-100.0, y=0, m=0, d=0)
        cells += [{**base, "col_pos": 0, "kind": "text", "txt": text}, {**base, "col_pos": 1, "kind": "num", "txt": None, "z": z},
                  {**base, "col_pos": 2, "kind": "date", "txt": None, "y": y, "m": m, "d": d}, {**base, "col_pos": 3, "kind": "text", "txt": "__LOOM_PAD__"}]
    cells = pd.DataFrame(cells).sample(frac=1, random_state=1)
    queries, context, near = neighbours.row_similarity(cells)
    assert queries.tolist() == list(range(20)) and context.tolist() == list(range(30))
    when = lambda r: r[4] + r[5] / 12 + r[6] / 372
    want = [[((q[2] == c[2]) + 1 / (1 + abs(q[3] - c[3])) + 1 / (1 + abs(when(q) - when(c)))) / 3 for c in rows[:30]] for q in rows[30:]]
    assert near == pytest.approx(np.array(want))
    values = neighbours.value_scorer(cells, nearest=3).set_index("row_ord")["pred"]
    for q in range(20):
        top = sorted(range(30), key=lambda c: (-near[q, c], c))[:3]
        assert values[q] == pytest.approx(sum((near[q, c] + 1e-6) * c * 0.5 for c in top) / sum(near[q, c] + 1e-6 for c in top))
    best = neighbours.class_scorer(cells)
    for r in best.itertuples():
        assert r.score == pytest.approx(np.log(p := max(near[r.row_ord, c] for c in range(30) if rows[c][2] == r.label)) - np.log1p(-p))
    bare = cells[cells["is_query"]]
    assert neighbours.class_scorer(bare).empty and neighbours.value_scorer(bare)["pred"].isna().all()


CELLS = ["bag", "query_chunk", "row_ord", "pos", "is_query", "target", "target_delta", "target_text", "col_pos", "col", "mask",
         "kind", "txt", "floor", "delta", "z", "y", "m", "d", "w"]


@pytest.mark.parametrize("regression", ["l2", "bins"])
@pytest.mark.parametrize("target, task", [("label", "classification"), ("value", "regression")])
def test_fitted_state_equals_samples_encoded_whole(spark, regression, target, task):
    frame, context, queries = tables(spark)
    features = ["size", "shade", "fixed", "gap", "day"]
    more = {
        "gap": F.expr("case when row_ord % 3 = 0 then null when row_ord % 17 = 1 then double('inf') when row_ord % 17 = 2 then double('nan') else row_ord * 0.5 end"),
        "day": F.expr("date_add(date'2020-01-01', cast(row_ord * 7 as int))"),
    }
    context, queries = context.withColumns(more).select("row_ord", *features, target), queries.withColumns(more).select("row_ord", *features)
    options = dict(bagging=3, m=40, chunk=20, config=SampleConfig(max_columns=500, pad=7))
    whole, _, _ = P.in_context_samples(context, queries, target, task, regression=regression, **options)
    bags, drawn = P.draw_context(context, 3, 40, options["config"].seed)
    held = drawn.select(F.col("bag").cast("bigint"), F.col("slot").cast("bigint").alias("row_ord"), *features, target)
    cells, state, kind = FT.fit_encoder(held, target, task, options["config"], regression)
    asked = FT.encode_queries(queries, state, target, task, options["config"], kind, chunk=20, regression=regression)
    assert state.count() == bags == 3 and cells.select("bag", "row_ord").distinct().count() == 120
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # by query chunk, never by bag
    chunks = [r[0] for r in whole.select("query_chunk").distinct().collect()]
    copies = cells.withColumn("query_chunk", F.explode(F.array(*[F.lit(c) for c in chunks])))
    fitted = copies.select(*CELLS).union(asked.select(*CELLS))

    # Label codes are drawn by sample: by bag here, by bag and chunk there.
    shown = [c for c in CELLS if task == "regression" or c != "target"]

    def rows(df):
        return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*shown).collect())

    assert rows(fitted) == rows(whole)
    if task == "classification":
        known = cells.groupBy("bag", "target_text").agg(F.count_distinct("target").alias("n"), F.min("target").alias("code"))
        codes = known.toPandas()
        assert (codes["n"] == 1).all() and not codes.duplicated(["bag", "code"]).any()
