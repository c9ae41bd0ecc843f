"""Corpus discovery, scans, guards, sink and whole-corpus plans on a small directory."""

import datetime
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabloom import constants as K
from tabloom.catalog import scans
from tabloom.operators import profile as P
from tabloom.plans.corpus import Encoding, corpus_samples
from tabloom.plans.prepare import SampleConfig
from tabloom.sources import corpus, guards, manifest, scan, sink


def make_table(n, seed, wide=False):
    rng = np.random.default_rng(seed)
    cols = {
        "id": np.arange(n),
        "size": rng.normal(size=n),
        "colour": rng.choice(["red", "green", "blue"], n),
        "flag": rng.random(n) < 0.5,
        "day": [datetime.date(2020, 1, 1) + datetime.timedelta(int(i)) for i in rng.integers(0, 99, n)],
        "grade": rng.integers(0, 5, n),
    }
    if wide:
        cols.update({f"x{i}": rng.random(n) for i in range(8)})
    return pa.table(cols)


@pytest.fixture(scope="session")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "b").mkdir()
    (root / "b-x").mkdir()
    (root / "regression").mkdir()
    pq.write_table(make_table(430, 1), root / "a.parquet", row_group_size=90)
    pq.write_table(make_table(300, 2), root / "b" / "nested.parquet")
    pq.write_table(make_table(200, 3), root / "b-x" / "other.parquet")
    pq.write_table(make_table(250, 4, wide=True), root / "regression" / "r.parquet")
    pq.write_table(make_table(0, 5), root / "empty.parquet")
    (root / "junk.parquet").write_bytes(b"not parquet at all")
    return str(root)


def test_manifest(spark, root):
    got = manifest.manifest(spark, root).orderBy("ord").collect()
    names = ["a", "b/nested", "b-x/other", "empty", "junk", "regression/r"]
    assert [r.table_id for r in got] == names  # path components compare one by one
    assert [r.ord for r in got] == list(range(6))
    assert [r.n_rows for r in got] == [430, 300, 200, 0, 0, 250]
    parts = [manifest.shard(manifest.manifest(spark, root), i, 4).collect() for i in range(4)]
    assert sorted(r.table_id for p in parts for r in p) == sorted(names)
    for wrong in ((0, 0), (4, 4), (-1, 4)):
        with pytest.raises(ValueError):
            manifest.shard(manifest.manifest(spark, root), *wrong)


def test_manifest_errors(spark, root, tmp_path):
    with pytest.raises(FileNotFoundError):
        manifest.manifest(spark, str(tmp_path / "absent"))
    with pytest.raises(NotADirectoryError):
        manifest.manifest(spark, root + "/a.parquet")
    with pytest.raises(FileNotFoundError):
        manifest.manifest(spark, str(tmp_path))


def test_epoch_plan_lists_empty_tables_and_refuses_unreadable_ones(spark, root, tmp_path):
    pq.write_table(make_table(430, 1), tmp_path / "a.parquet", row_group_size=90)
    pq.write_table(make_table(0, 5), tmp_path / "empty.parquet")
    (tmp_path / "parts.parquet").mkdir()
    for i in range(2):
        pq.write_table(make_table(7, i), tmp_path / "parts.parquet" / f"{i}.parquet")
    assert sorted(map(tuple, manifest.table_rows(spark, str(tmp_path)).collect())) == [("a", 430), ("empty", 0), ("parts", 14)]
    plan = scans.epoch_plan(spark, str(tmp_path)).groupBy("table_id").count()
    assert sorted(map(tuple, plan.collect())) == [("a", 5), ("empty", 5), ("parts", 5)]
    with pytest.raises(ValueError, match="junk.parquet"):
        scans.epoch_plan(spark, root)
    whole = (tmp_path / "a.parquet").read_bytes()
    (tmp_path / "parts.parquet" / "1.parquet").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(ValueError, match="parts.parquet/1.parquet"):  # a part of a table is missed as well
        manifest.table_rows(spark, str(tmp_path))
    reasons = {r.table_id: (r.n_rows, r.reason is None) for r in manifest.manifest(spark, str(tmp_path)).collect()}
    assert reasons == {"a": (430, True), "empty": (0, True), "parts": (7, False)}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        manifest.table_rows(spark, str(tmp_path / "none"))


def test_schema_groups_report_unreadable_files(spark, root):
    groups, unreadable = scan.schema_groups(spark, root)
    assert sorted(len(paths) for _, paths, _ in groups) == [1, 1, 3]  # the empty table has an untyped column
    assert [u.split("/")[-1] for u in unreadable] == ["junk.parquet"]


def test_chunks_span_row_groups_and_drop_short_tails(spark, root):
    rows = scan.union_all(
        [f.select("table_id", "row_ord") for f in scan.corpus_tables(spark, root)]
    )
    cut = scan.cut_chunks(rows, 100, 50).groupBy("table_id", "chunk_id").count().collect()
    sizes = {(r.table_id, r.chunk_id): r["count"] for r in cut}
    assert sizes == {
        **{("a", i): 100 for i in range(4)},  # the tail of 30 rows is gone
        **{("b/nested", i): 100 for i in range(3)},
        **{("b-x/other", i): 100 for i in range(2)},
        **{("regression/r", i): 100 for i in range(2)}, ("regression/r", 2): 50,
    }


def test_chunk_size():
    assert scan.chunk_size() == 2
    assert scan.chunk_size(10, 100, (50, 900)) == 901
    assert scan.chunk_size(10, explicit=7) == 7
    with pytest.raises(ValueError):
        scan.chunk_size(explicit=0)


def test_profile_of_all_columns(spark, root):
    cells = scan.corpus_cells(scan.corpus_tables(spark, root), 1000)
    got = {(r.table_id, r.col): r for r in P.profile(cells).collect()}
    a = make_table(430, 1).to_pandas()
    for c in a.columns:
        assert got["a", c].n_rows == 430 and got["a", c].n_distinct == a[c].nunique()
    assert got["a", "day"].is_date and got["a", "size"].is_num and got["a", "flag"].kind == "text"


def test_invalid_text_drops_its_chunk(spark):
    rows = spark.range(30).select(
        F.lit("t").alias("table_id"), F.floor(F.col("id") / 10).alias("chunk_id"),
        F.when(F.col("id") == 14, F.unhex(F.lit("C328")).cast("string")).otherwise("fine").alias("s"),
    )
    kept = guards.drop_invalid_text(rows).groupBy("chunk_id").count().collect()
    assert sorted(map(tuple, kept)) == [(0, 10), (2, 10)]


def test_sink_types_and_empty_result(spark, tmp_path):
    rows = [("classification", "s1", 0, 3.0), ("regression", "s1", 0, 0.25)]
    df = spark.createDataFrame(rows, "task string, stage string, epoch int, target double")
    path = str(tmp_path / "out")
    got = {r.task: (r.target_int, r.target_float) for r in sink.write_samples(df, path).collect()}
    assert got == {"classification": (3, None), "regression": (None, 0.25)}
    again = sink.write_samples(df.where("task = 'regression'"), path)
    assert again.count() == 1 and spark.read.parquet(path).count() == 2  # only that partition was replaced
    with pytest.raises(ValueError):
        sink.write_samples(df.where("false"), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sink.write_samples(df.where("false"), path)  # older output does not hide an empty run


def test_shards_of_an_epoch_do_not_replace_each_other(spark, tmp_path):
    rows = [("regression", "s1", 0, 0.25), ("regression", "s1", 0, 0.5)]
    df = spark.createDataFrame(rows, "task string, stage string, epoch int, target double")
    path = str(tmp_path / "out")
    for shard in (0, 1, 1):
        assert sink.write_samples(df, path, shard).count() == 2
    assert sorted(r.shard for r in spark.read.parquet(path).collect()) == [0, 0, 1, 1]


def test_sink_deals_whole_samples_to_small_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).selectExpr("id as event_id", "concat('t', id % 7) as event_type", "id % 97 / 7.0 as value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(K, "TASK_ROWS", 2_000, raising=False)
    write = sink.write_samples

    def placed(samples, path):
        return write(samples.withColumn("part", F.spark_partition_id()), path)

    monkeypatch.setattr(sink, "write_samples", placed)
    monkeypatch.setattr(scans, "fresh_path", lambda *_: str(tmp_path / "out"))
    got = {(r.task, r.epoch): r.n_rows for r in scans.sample_sink(spark, str(tmp_path)).collect()}
    assert got == {(t, e): 20_000 for t in ("classification", "regression") for e in (0, 1)}
    out = spark.read.parquet(str(tmp_path / "out"))
    parts = out.groupBy("task", "epoch", "chunk_id").agg(F.count_distinct("part").alias("n"))
    assert {r.n for r in parts.collect()} == {1}
    assert max(r["count"] for r in out.groupBy("part").count().collect()) <= 80_000 * 3 // 10


def test_read_errors_are_retried_and_then_raised(tmp_path):
    calls, path = [], str(tmp_path / "whole")
    (tmp_path / "whole").write_bytes(b"bytes")

    def broken(error):
        def read():
            calls.append(1)
            raise error

        return read

    with pytest.raises(OSError):  # its bytes cannot be fetched: the store is away
        corpus.attempt(path + "-absent", broken(OSError("store is away")), wait=0)
    assert len(calls) == 3
    assert corpus.attempt(path, broken(OSError("page header")), wait=0) == (None, "OSError: page header")
    assert corpus.attempt(path, broken(pa.ArrowInvalid("no magic"))) == (None, "ArrowInvalid: no magic")
    assert len(calls) == 7 and corpus.attempt(path, lambda: 5) == (5, None)


@pytest.fixture(scope="module")
def broken_root(tmp_path_factory):
    """A whole table, one with a broken page in its second row group, one cut short, one that is none."""
    root = tmp_path_factory.mktemp("broken")
    table = make_table(400, 1)
    for name in ("whole", "page", "cut"):
        pq.write_table(table, root / f"{name}.parquet", row_group_size=100, compression="none")
    data = bytearray((root / "page.parquet").read_bytes())
    column = pq.ParquetFile(root / "page.parquet").metadata.row_group(1).column(0)
    start = column.dictionary_page_offset or column.data_page_offset
    data[start : start + 60] = b"\xff" * 60
    (root / "page.parquet").write_bytes(data)
    whole = (root / "cut.parquet").read_bytes()
    (root / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (root / "junk.parquet").write_bytes(b"not parquet at all")
    return str(root)


def test_plan_cuts_files_between_row_groups(spark, root):
    plan = corpus.plan_corpus(spark, root, split_bytes=1)
    got = plan.readable().where("table_id = 'a'").orderBy("first").collect()
    assert [(r.first, r.end, r.first_row, r.n_rows, r.table_rows) for r in got] == [
        (0, 1, 0, 90, 430), (1, 2, 90, 90, 430), (2, 3, 180, 90, 430), (3, 4, 270, 90, 430), (4, 5, 360, 70, 430)]
    assert {r.table_id: r.n_rows for r in plan.table_rows().collect()} == {
        "a": 430, "b/nested": 300, "b-x/other": 200, "empty": 0, "junk": 0, "regression/r": 250}
    assert [(r.table_id, r.row_group) for r in plan.skipped().collect()] == [("junk", None)]


@pytest.mark.parametrize("split_bytes, task_bytes", [(1, 1), (1, 1 << 30), (1 << 30, 1 << 30)])
def test_source_gives_the_rows_that_spark_reads(spark, root, split_bytes, task_bytes):
    plan = corpus.plan_corpus(spark, root, split_bytes=split_bytes)
    for key, schema in plan.schemas():
        splits, which = plan.readable().where(F.col("schema_key") == key), {"schema_key": key}
        got = corpus.read_rows(plan, which, schema, 100, 50, task_bytes=task_bytes)
        paths = [r.path for r in splits.select("path").distinct().collect()]
        want = scan.cut_chunks(scan.scan(spark, root, paths, schema), 100, 50)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        probe = corpus.read_rows(plan, which, schema, 100, 50, columns=["grade"], probe=True, task_bytes=task_bytes)
        assert probe.columns == ["table_id", "chunk_id", "row_ord", "grade"]
        want = scan.probe_chunk(want).select(*probe.columns)
        assert sorted(map(str, probe.collect())) == sorted(map(str, want.collect()))


def test_broken_row_groups_are_left_out_and_reported(spark, broken_root):
    plan = corpus.plan_corpus(spark, broken_root, split_bytes=1)
    ((_, schema),) = plan.schemas()
    rows = corpus.read_rows(plan, {}, schema, 100)
    counts = {(r.table_id, r.chunk_id): r["count"] for r in rows.groupBy("table_id", "chunk_id").count().collect()}
    assert counts == {**{("whole", i): 100 for i in range(4)}, **{("page", i): 100 for i in (0, 2, 3)}}
    rows.count()  # a second pass reports nothing twice
    report = {(r.table_id, r.row_group, r.first_row): r.reason for r in plan.skipped().collect()}
    assert set(report) == {("page", 1, 100), ("cut", None, None), ("junk", None, None)} and all(report.values())
    probed = corpus.probe_cells(corpus.plan_corpus(spark, broken_root), 150).groupBy("table_id").agg(F.max("row_ord").alias("m")).collect()
    assert {r.table_id: r.m for r in probed} == {"whole": 149, "page": 99}  # the same rule in a probe


CONFIG = SampleConfig(
    query_range=(20, 60), shuffle=True, min_rows=150, max_rows=150, rows_per_chunk=150, balanced=True,
    skip_ineligible=True,
)


def test_corpus_samples_auto(spark, root):
    got = corpus_samples(spark, root, CONFIG).toPandas()
    assert set(got["table_id"]) <= {"a", "b/nested", "b-x/other", "regression/r"}
    assert not got.groupby("table_id")["target_column"].nunique().gt(1).any()
    for _, g in got.groupby(["table_id", "chunk_id", "replica"]):
        rows = g.drop_duplicates("row_ord")
        assert len(rows) == 150 and 20 <= rows["is_query"].sum() <= 60
        assert (rows.loc[rows["is_query"], "target"] == -100).all()
        assert (rows.loc[~rows["is_query"], "target"] >= 0).all()
    assert got["col"].ne(got["target_column"]).all()


def test_corpus_samples_do_not_depend_on_shards(spark, root):
    config = SampleConfig(**{**CONFIG.__dict__, "balanced": False})
    order = ["table_id", "chunk_id", "row_ord", "col"]
    whole = corpus_samples(spark, root, config).toPandas()
    parts = [corpus_samples(spark, root, config, shard=(i, 6)) for i in (0, 1, 2)]
    for part in parts:
        part = part.toPandas().sort_values(order).reset_index(drop=True)
        same = whole[whole["table_id"].isin(part["table_id"])].sort_values(order).reset_index(drop=True)
        assert part[whole.columns].equals(same)


def test_corpus_samples_fixed(spark, root):
    config = SampleConfig(
        query_range=(20, 60), target="grade", auto_target=False, skip_ineligible=True,
        min_rows=100, max_rows=100, rows_per_chunk=100, max_columns=5, pad=4, query_chunk=30,
    )
    got = corpus_samples(spark, root, config, Encoding(regression="l2")).toPandas()
    # The task comes from the path here; an integer target is no class, so only 'regression' stays.
    assert set(got["table_id"]) == {"regression/r"} and set(got["task"]) == {"regression"}
    counts = got.groupby(["chunk_id", "row_ord"])["col"].nunique()
    assert (counts == 4).all()
    assert got.loc[got["is_query"], "query_chunk"].max() <= 1


def test_too_small_chunks_fail_early(spark, root):
    with pytest.raises(ValueError, match="probe minimum"):
        corpus_samples(spark, root, SampleConfig(query_range=(2, 5)))


def test_corpus_samples_read_each_file_once(spark, root, monkeypatch):
    read = []
    kept = corpus.read_rows

    def watched(plan, which, *args, at=None, **options):
        splits = spark.read.parquet(at or plan.path)
        for column, value in which.items():
            splits = splits.where(F.col(column) == value)
        read.append((options.get("probe", False), [r.table_id for r in splits.select("table_id").collect()]))
        return kept(plan, which, *args, at=at, **options)

    monkeypatch.setattr(corpus, "read_rows", watched)
    plan = corpus.plan_corpus(spark, root)
    samples = corpus_samples(spark, root, CONFIG, plan=plan)
    scans = [t for probe, tables in read if not probe for t in tables]
    assert len(scans) == len(set(scans)) and {"a", "b/nested"} <= set(scans)
    text = samples._jdf.queryExecution().executedPlan().toString()
    assert text.count("BatchScan") == sum(not probe for probe, _ in read)
    assert len(re.findall(r"Exchange hashpartitioning\(table_id", text)) <= sum(not probe for probe, _ in read) + 2
    assert samples.count() and [r.table_id for r in plan.skipped().collect()] == ["junk"]


def test_corpus_samples_run_in_few_tasks_of_short_methods(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "TASK_ROWS", 150)
    table = make_table(400, 1, wide=True)
    for i in range(4):
        table = table.append_column(f"y{i}", pa.array(np.random.default_rng(i).random(400)))
    pq.write_table(table, tmp_path / "a.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        plan = corpus_samples(spark, str(tmp_path), CONFIG)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) <= 8_000  # above it the JVM interprets a method for ever
    assert re.findall(r"hashpartitioning\(chunk_id[^)]*, (\d+)\), REPARTITION_BY_NUM", plan.toString()) == ["3"]  # by the rows


def test_samples_of_broken_tables_keep_whole_chunks_and_bad_text_goes(spark, broken_root):
    config = SampleConfig(**{**CONFIG.__dict__, "balanced": False, "min_rows": 100, "max_rows": 100, "rows_per_chunk": 200, "query_range": (20, 60)})
    plan = corpus.plan_corpus(spark, broken_root)
    got = corpus_samples(spark, broken_root, config, plan=plan)
    chunks = {(r.table_id, r.chunk_id) for r in got.select("table_id", "chunk_id").distinct().collect()}
    assert ("whole", 0) in chunks and {t for t, _ in chunks} <= {"whole", "page"}
    assert {(r.table_id, r.row_group) for r in plan.skipped().collect()} == {("page", 1), ("cut", None), ("junk", None)}


def test_chunk_flags_as_windows(spark):
    rows = spark.range(30).select(
        F.lit("t").alias("table_id"), F.floor(F.col("id") / 10).alias("chunk_id"), F.lit(0).alias("replica"),
        F.when(F.col("id") == 14, F.unhex(F.lit("C328")).cast("string")).otherwise("fine").alias("s"),
    )
    kept = rows.withColumn("ok", guards.valid_chunk(rows, ("table_id", "chunk_id", "replica"))).where("ok")
    assert sorted(map(tuple, kept.groupBy("chunk_id").count().collect())) == [(0, 10), (2, 10)]
