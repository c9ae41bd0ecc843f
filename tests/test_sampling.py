"""Row sampling, splits and bags: fixtures and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import ranking as R
from tabloom.operators import sampling as S
from tabloom.operators import targets as G


def table(spark, n, size=None, parts=3):
    rows = spark.range(n).repartition(parts)
    rows = rows.select(F.lit("t").alias("table_id"), F.col("id").alias("row_ord"))
    return rows.withColumn("chunk_id", F.floor(F.col("row_ord") / (size or n)))


STARTS = {
    (100, 30): [0, 23, 46, 70],
    (30, 30): [0],
    (29, 30): [0],
    (1000, 30): [0, 64, 129, 194, 258, 323, 388, 452, 517, 582, 646, 711, 776, 840, 905, 970],
}


@pytest.mark.parametrize("n,m", STARTS)
def test_sliding_bags(spark, n, m):
    bags = S.sliding_bags(table(spark, n), m, 7).toPandas()
    order = S.draw_rank(
        table(spark, n).withColumn("_d", S.draw(7, "bag_order", "table_id", "row_ord")),
        ["table_id"], "_d", ["row_ord"],
    ).toPandas().set_index("row_ord")["rank"]
    starts = [int(order[g["row_ord"]].min()) for _, g in bags.groupby("bag")]
    assert starts == STARTS[n, m]
    assert len(starts) == 16 or set(bags["row_ord"]) == set(range(n))
    assert all(sorted(g["slot"]) == list(range(min(n, m))) for _, g in bags.groupby("bag"))


def test_bucketed_rank_is_the_global_order(spark):
    drawn = table(spark, 5000).withColumn("_d", S.draw(1, "x", "row_ord"))
    got = R.draw_rank(drawn, ["table_id"], "_d", ["row_ord"], bits=6).toPandas()
    got = got.sort_values(["_d", "row_ord"])
    assert got["rank"].tolist() == list(range(5000))


def test_first_by_draw_equals_sort_and_limit(spark):
    drawn = table(spark, 3000).withColumn("_d", S.draw(1, "x", "row_ord"))
    got = {r.row_ord for r in R.first_by_draw(drawn, ["table_id"], "_d", ["row_ord"], 100).collect()}
    want = {r.row_ord for r in drawn.orderBy("_d", "row_ord").limit(100).collect()}
    assert got == want


def test_bootstrap_draws_exactly_m_rows_even_beyond_n(spark):
    bags = S.bootstrap_bags(table(spark, 40), 3, 100, 5).toPandas()
    assert bags.groupby("bag").size().tolist() == [100] * 3
    assert bags["row_ord"].between(0, 39).all()


def test_bag_configuration(spark):
    rows = table(spark, 50)
    assert S.make_bags(rows, 1, 20, 3).count() == 20
    assert S.make_bags(rows, 1, 80, 3).count() == 50
    for wrong in (0, -1, "many", 1.5, True):
        with pytest.raises(ValueError):
            S.make_bags(rows, wrong, 20, 3)


@pytest.mark.parametrize("options", [{"fit_size": 7}, {"fit_size": 0.33}, {"query_range": (50, 3)}, {"query_range": (500, 900)}])
def test_split_is_a_partition(spark, options):
    ordered = S.order_rows(table(spark, 95, 20), 11, shuffle=True)
    got = S.split_context(ordered, 11, **options).toPandas()
    assert len(got) == 95 and got["row_ord"].is_unique
    for _, g in got.groupby("chunk_id"):
        assert sorted(g["pos"]) == list(range(1, len(g) + 1))
        assert 1 <= g["is_query"].sum() < len(g)
    if options == {"fit_size": 0.33}:
        assert (got.groupby("chunk_id")["is_query"].sum() == [14, 14, 14, 14, 11]).all()


@pytest.mark.parametrize("wrong", [{}, {"fit_size": True}, {"fit_size": 1.5}])
def test_split_refuses_bad_sizes(spark, wrong):
    with pytest.raises(ValueError):
        S.split_context(S.order_rows(table(spark, 10), 1), 1, **wrong)


def test_split_refuses_an_empty_side(spark):
    with pytest.raises(Exception, match="leave a row"):
        S.split_context(S.order_rows(table(spark, 10), 1), 1, fit_size=10).collect()


def test_sampling_does_not_depend_on_partitioning(spark):
    def run(parts):
        ordered = S.order_rows(table(spark, 500, 100, parts), 3, cap=60, shuffle=True)
        return sorted(map(tuple, S.split_context(ordered, 3, query_range=(5, 30)).select("row_ord", "pos", "is_query").collect()))

    assert run(1) == run(7) and len(run(2)) == 300


def test_row_order_without_shuffle_is_file_order(spark):
    got = S.order_rows(table(spark, 30, 10), 3).toPandas()
    assert (got["pos"] == got["row_ord"] % 10 + 1).all()


def test_query_chunks(spark):
    split = S.split_context(S.order_rows(table(spark, 100), 3), fit_size=40)
    sizes = S.query_chunks(split, 25).groupBy("query_chunk").count().orderBy("query_chunk").collect()
    assert [tuple(r) for r in sizes] == [(0, 25), (1, 25), (2, 10)]
    assert S.query_chunks(split).select("query_chunk").distinct().count() == 1
    with pytest.raises(ValueError):
        S.query_chunks(split, 0)


def specs(spark, n_reg, n_cls):
    rows = [(f"r{i}", "x", "regression") for i in range(n_reg)] + [(f"c{i}", "y", "classification") for i in range(n_cls)]
    return spark.createDataFrame(rows, "table_id string, col string, task string")


@pytest.mark.parametrize("n_reg,n_cls,want", [(9, 4, 9), (4, 9, 9), (5, 0, 0), (0, 3, 3), (4, 4, 4)])
def test_balance(spark, n_reg, n_cls, want):
    got = G.balance(specs(spark, n_reg, n_cls), 1).toPandas()
    assert (got["task"] == "classification").sum() == want
    assert (got["task"] == "regression").sum() == n_reg
    assert not got.duplicated(["table_id", "replica"]).any()


def test_spec_order_is_dense(spark):
    given = specs(spark, 5, 4).withColumn("replica", F.lit(0).cast("bigint"))
    assert sorted(r.spec_idx for r in G.order_specs(given, 2).collect()) == list(range(9))


def test_target_name():
    assert G.resolve_target(["a", "b"]) == "b"
    assert G.resolve_target(["a", "b"], "a") == "a"
    assert G.resolve_target(["1", "b"], 1) == "1"
    with pytest.raises(ValueError):
        G.resolve_target(["a"], "z")


def test_date_targets_are_an_error(spark):
    bad = spark.createDataFrame([("t", "d", "date", "/p")], "table_id string, col string, kind string, path string")
    with pytest.raises(Exception, match="date-like"):
        G.infer_task(bad).collect()


def test_draws_are_spread_evenly(spark):
    got = table(spark, 20000).select((S.draw(1, "u", "row_ord") / 2**32).alias("u")).toPandas()["u"]
    assert abs(got.mean() - 0.5) < 0.01 and np.histogram(got, 10)[0].min() > 1800
