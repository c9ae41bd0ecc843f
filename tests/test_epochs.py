"""Epochs written by stage and shard: repeated, interrupted and read back."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabloom.plans import epochs
from tabloom.plans.corpus import Encoding
from tabloom.plans.epochs import Stage, commits, read_epochs, write_epochs
from tabloom.plans.prepare import SampleConfig
from tabloom.sources import manifest, scan

from test_sources import make_table, root  # noqa: F401  (the small corpus)

CONFIG = dict(query_range=(20, 60), auto_target=False, target="grade", min_rows=100, max_rows=100, rows_per_chunk=100, shuffle=True)
STAGES = [Stage("one", SampleConfig(**CONFIG), 2), Stage("two", SampleConfig(**CONFIG, keyword="corpus"), 1, Encoding(regression="l2"))]
ROW = ["stage", "epoch", "table_id", "chunk_id", "row_ord", "col", "is_query", "target_int", "target_float"]


def cells(spark, path):
    return sorted(map(str, read_epochs(spark, path).select(*ROW).collect()))


def test_a_killed_shard_leaves_one_copy(spark, root, tmp_path, monkeypatch):  # noqa: F811
    clean, path = str(tmp_path / "clean"), str(tmp_path / "killed")
    for shard in ((0, 6), (1, 6)):
        done = write_epochs(spark, root, clean, STAGES, shard).collect()
        assert {(r.stage, r.epoch) for r in done} == {("one", 0), ("one", 1), ("two", 0)}
    rows = read_epochs(spark, clean).where("col_pos = 0")
    counts = {(r.table_id, r.stage, r.epoch): r["count"] for r in rows.groupBy("table_id", "stage", "epoch").count().collect()}
    assert counts == {(t, s.name, e): n for t, n in (("a", 400), ("b/nested", 300)) for s in STAGES for e in range(s.epochs)}
    types = {(r.stage, r.target_int is None, r.target_float is None) for r in rows.collect()}
    assert types == {("one", False, True), ("two", True, False)}

    kept, calls = epochs._commit, []

    def dies(written, at):
        calls.append(at)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return kept(written, at)

    monkeypatch.setattr(epochs, "_commit", dies)
    with pytest.raises(RuntimeError, match="killed"):
        write_epochs(spark, root, path, STAGES, (0, 6))
    assert {(r.stage, r.epoch) for r in commits(spark, path).collect()} == {("one", 0)}
    # Its samples lie there, but are not committed and not read.
    assert spark.read.parquet(f"{path}/samples").where("epoch = 1").count()
    assert {r.epoch for r in read_epochs(spark, path).select("epoch").distinct().collect()} == {0}
    monkeypatch.setattr(epochs, "_commit", kept)
    made, seen = epochs.corpus_samples, []
    monkeypatch.setattr(epochs, "corpus_samples", lambda *a: seen.append(a[5]) or made(*a))
    write_epochs(spark, root, path, STAGES, (0, 6))
    assert seen == [1, 0]  # the committed epoch is not made again
    write_epochs(spark, root, path, STAGES, (1, 6))
    write_epochs(spark, root, path, STAGES, (0, 6))
    assert len(seen) == 5
    assert cells(spark, path) == cells(spark, clean)


def test_commits_sum_up_what_was_written(spark, root, tmp_path):  # noqa: F811
    path = str(tmp_path / "sums")
    done = write_epochs(spark, root, path, STAGES[:1], (0, 6)).where("epoch = 1").first()
    rows = read_epochs(spark, path).where("epoch = 1")
    first = rows.where("col_pos = 0")
    own = first.agg(F.count(F.lit(1)), F.count_if("is_query"), F.sum(F.when(~F.col("is_query"), F.col("target_int")))).first()
    assert (done.n_cells, done.n_rows, done.n_query, done.target_sum) == (rows.count(), *own[:2], float(own[2]))
    epochs_differ = {tuple(r) for r in first.select("row_ord", "is_query").collect()}
    assert epochs_differ != {tuple(r) for r in read_epochs(spark, path).where("epoch = 0 and col_pos = 0").select("row_ord", "is_query").collect()}


def test_shard_counts_and_stage_names_must_agree(spark, root, tmp_path):  # noqa: F811
    path = str(tmp_path / "mixed")
    write_epochs(spark, root, path, STAGES[1:], (0, 6))
    with pytest.raises(ValueError, match="00000-of-00006"):
        write_epochs(spark, root, path, STAGES[1:], (0, 3))
    with pytest.raises(ValueError, match="share a name"):
        write_epochs(spark, root, path, [STAGES[0], STAGES[0]])


def test_a_folder_of_parts_is_one_table(spark, tmp_path):
    table, made = make_table(430, 1), {}
    for name in ("file", "parts"):
        (tmp_path / name).mkdir()
        pq.write_table(make_table(300, 2), tmp_path / name / "b.parquet")
    pq.write_table(table, tmp_path / "file" / "a.parquet")
    (tmp_path / "parts" / "a.parquet").mkdir()
    for i, (start, stop) in enumerate(((0, 130), (130, 130), (130, 280), (280, 430))):
        pq.write_table(table.slice(start, stop - start), tmp_path / "parts" / "a.parquet" / f"part-{i}.parquet", row_group_size=70)
    for name in ("file", "parts"):
        at, path = str(tmp_path / name), str(tmp_path / f"epochs-{name}")
        write_epochs(spark, at, path, STAGES[:1], (0, 2))
        tables = [tuple(r) for r in manifest.manifest(spark, at).select("table_id", "ord", "n_rows").orderBy("ord").collect()]
        rows = scan.union_all([f.select("table_id", "row_ord", "id") for f in scan.corpus_tables(spark, at)])
        assert rows.where("row_ord <> id").isEmpty() and rows.distinct().count() == 730
        made[name] = tables, cells(spark, path)
    assert made["parts"] == made["file"] and made["file"][0] == [("a", 0, 430), ("b", 1, 300)]
