"""Encodings against hand-computed fixtures and an independent NumPy computation."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.constants import HIDDEN, MISSING_BIN
from tabloom.functions import channels as CH
from tabloom.operators import encode as E

SCHEMA = "table_id string, chunk_id long, row_ord long, x double, is_query boolean"


def sample(spark, context, query):
    values = [(v, False) for v in context] + [(v, True) for v in query]
    rows = [("t", 0, i, None if v is None else float(v), q) for i, (v, q) in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_bins_fixture(spark):
    rows = sample(spark, [1.0, 1, 2, 2, 3, 3, 4, 100], [0.0, 2.5, 1000.0, None])
    edges = E.sample_edges(rows, "x").first().edges
    assert edges == pytest.approx(
        [1, 1, 1, 1.09375, 1.53125, 1.96875, 2, 2, 2.28125, 2.71875, 3, 3, 3.03125, 3.46875, 3.90625, 37, 79, 100]
    )
    out = [r.x__code for r in E.quantile_bin(rows, ["x"]).orderBy("row_ord").collect()]
    assert [c.floor for c in out] == [1, 1, 6, 6, 10, 10, 13, 14, 0, 7, 14, MISSING_BIN]
    assert [c.delta for c in out] == pytest.approx(
        [0, 0, 0, 0, 0, 0, 0.002833, 1, 0, 0.5, 1, 0], abs=1e-6
    )
    assert [c.bin for c in out] == [1, 1, 6, 6, 10, 10, 13, 15, 0, 8, 15, None]


def numpy_bins(context, values, bins=16):
    q = np.quantile(context, (2 * np.arange(bins) + 1) / (2 * bins))
    edges = np.concatenate([[min(context)], q, [max(context)]])
    i = np.clip(np.searchsorted(edges, values, side="right") - 1, 1, bins - 1)
    delta = np.clip((values - edges[i]) / np.maximum(edges[i + 1] - edges[i], 1e-10), 0, 1)
    return i - 1, delta, np.round(i - 1 + delta)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_bins_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    context = rng.normal(size=200) if seed else np.floor(rng.uniform(0, 6, 200))
    query = rng.normal(size=50) * 2
    rows = sample(spark, context.tolist(), query.tolist())
    got = [r.x__code for r in E.quantile_bin(rows, ["x"]).orderBy("row_ord").collect()]
    floor, delta, code = numpy_bins(context, np.concatenate([context, query]))
    assert [g.floor for g in got] == floor.tolist()
    assert [g.delta for g in got] == pytest.approx(delta.tolist(), abs=1e-9)
    assert [g.bin for g in got] == code.tolist()
    assert all(0 <= g.floor <= 14 and 0 <= g.delta <= 1 and 0 <= g.bin <= 15 for g in got)


def test_infinite_only_column_is_missing(spark):
    inf = float("inf")
    got = E.quantile_bin(sample(spark, [inf, -inf], [1.0]), ["x"]).collect()
    assert {r.x__code.floor for r in got} == {MISSING_BIN}


def test_infinite_values_are_drawn_in_per_side(spark):
    inf = float("inf")
    out = E.clamp_inf(sample(spark, [1.0, 5.0, inf], [9.0, -inf]), ["x"]).orderBy("row_ord")
    assert [r.x__clamped for r in out.collect()] == [1.0, 5.0, 6.0, 9.0, 8.0]


@pytest.mark.parametrize(
    "role,mean,std,scaled",
    [
        ("target", 21.62, 34.91085, [-0.590074, -0.562003, -0.533359, -0.504714, 0, 2.19015, -0.590074, 0, 0.812928]),
        ("feature", 21.679167, 34.899703, [-0.591815, -0.563878, -0.535224, -0.506571, 0.009193, 2.188295, -0.591815, 0.009193, 0.811492]),
    ],
)
def test_scale_fixture(spark, role, mean, std, scaled):
    rows = sample(spark, [1.0, 2.0, 3.0, 4.0, None, 100.0], [0.0, None, 50.0])
    out = E.standardise(rows, ["x"], role=role).orderBy("row_ord").collect()
    assert out[0].x__mean == pytest.approx(mean, abs=1e-5)
    assert out[0].x__std == pytest.approx(std, abs=1e-5)
    assert [r.x__z for r in out] == pytest.approx(scaled, abs=1e-5)


def test_scale_without_values_and_without_variance(spark):
    none = E.standardise(sample(spark, [None, None], [3.0]), ["x"]).collect()
    assert {(r.x__z, r.x__mean, r.x__std) for r in none} == {(0.0, 0.0, 1.0)}
    flat = E.standardise(sample(spark, [2.0, 2.0], [9.0]), ["x"]).orderBy("row_ord").collect()
    assert [(r.x__z, r.x__std) for r in flat] == [(0.0, 0.0)] * 3


def test_date_codes_fixture(spark):
    d = datetime.date
    days = [d(1999, 12, 31), d(2024, 2, 29), d(2050, 6, 1), d(2077, 1, 5), None]
    rows = spark.createDataFrame([(x,) for x in days], "d date")
    codes = CH.date_codes(CH.channel_value("d", T.DateType(), "date"))
    got = [tuple(r) for r in rows.select(*codes.values()).collect()]
    assert got == [(1, 12, 31, 5), (25, 2, 29, 4), (51, 6, 1, 3), (51, 1, 5, 2), (0, 0, 0, 0)]


def test_channels_of_all_types(spark):
    schema = (
        "i int, f float, b boolean, s string, dec decimal(10,2), d date, ts timestamp_ntz, t string, "
        "arr array<int>, m map<string,int>, st struct<a:int>"
    )
    from decimal import Decimal

    full = (1, float("nan"), True, "x", Decimal("1.50"), datetime.date(2020, 1, 1),
            datetime.datetime(2020, 1, 1), "12:30:00.5", [1, 2], {"k": 1}, (7,))
    df = spark.createDataFrame([full, (None,) * 11], schema)
    kinds = CH.kinds(df.schema, times=("t",))
    assert list(kinds.values()) == "num num text text text date date time text text text".split()
    values = df.select(*[CH.channel_value(f.name, f.dataType, kinds[f.name]).alias(f.name) for f in df.schema])
    row, empty = values.collect()
    assert (row.i, row.f, row.b, row.dec, row.t) == (1.0, None, "True", "1.50", 45000.5)
    assert (row.arr, row.m, row.st) == ("[1,2]", '{"k":1}', '{"a":7}')
    assert all(v is None for v in empty)
    assert df.select(CH.text("b", T.BooleanType())).collect()[1][0] == "None"


def labels(spark, context, query):
    rows = [("t", 0, i, v, q) for i, (v, q) in enumerate([(c, False) for c in context] + [(c, True) for c in query])]
    return spark.createDataFrame(rows, "table_id string, chunk_id long, row_ord long, y string, is_query boolean")


def test_label_codes(spark):
    many = [f"c{i:03d}" for i in range(80) for _ in range(1 + (i < 70))]
    out = E.encode_target(labels(spark, many + [None], ["c000", "new"]), "y", "classification")
    rows = out.orderBy("row_ord").collect()
    codes = {r.y: r.truth for r in rows}
    kept = {y: c for y, c in codes.items() if c != 62}
    assert sorted(kept.values()) == list(range(62)) and codes["new"] == 62 and codes[None] == 62
    assert all(y < "c062" for y in kept)  # ties of equal count go to the smaller label
    assert [r.target for r in rows if r.is_query] == [HIDDEN, HIDDEN]
    wide = E.encode_target(labels(spark, many, ["new"]), "y", "classification", classification="clustering")
    codes = {r.y: r.truth for r in wide.collect()}
    assert codes.pop("new") == 80 and sorted(codes.values()) == list(range(80))


@pytest.mark.parametrize("regression", ["bins", "l2"])
def test_query_targets_never_reach_the_context(spark, regression):
    base = sample(spark, [1.0, 4.0, 2.0, 8.0], [3.0, 5.0])
    changed = base.withColumn("x", F.when(F.col("is_query"), F.lit(1e6)).otherwise(F.col("x")))
    shown = lambda df: [
        (r.target, r.target_delta)
        for r in E.encode_target(df, "x", "regression", regression=regression).orderBy("row_ord").collect()
    ]
    assert shown(base) == shown(changed)
    assert shown(base)[4:] == [(HIDDEN, 0.0)] * 2
