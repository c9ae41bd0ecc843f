"""Vectors beside encoded samples, and inline."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import text as X
from tabloom.plans import vectors as V
from tabloom.sources import dictionary as D

KEYS = ("table_id", "chunk_id")


@pytest.fixture(scope="module")
def cells(spark):
    """Ten samples with a common text, own texts, an empty text, no texts in numeric cells, and labels."""
    rows = spark.range(4000).select(
        F.lit("t").alias("table_id"), (F.col("id") % 10).alias("chunk_id"), F.col("id").alias("row_ord"),
        F.when(F.col("id") % 3 > 0, F.lit("common words")).when(F.col("id") % 2 > 0, F.concat(F.lit("own "), F.col("id").cast("string")))
        .when(F.col("id") % 4 > 0, F.lit("")).alias("txt"),
        F.when(F.col("id") % 2 > 0, F.lit("col a")).otherwise(F.lit("common words")).alias("col"),
        F.when(F.col("id") % 5 == 0, F.lit("label")).alias("target_text"), F.lit("the target").alias("target_column"),
    )
    return rows.cache()


def embedder(calls):
    def embed(texts):
        calls.extend(r.txt for r in texts.select("txt").collect())
        return texts.select("text_id", F.array(F.length("txt").cast("double"), F.lit(1.0) / 3).alias("vec"))

    return embed


def test_vectors_lie_beside_samples_once_each(spark, cells):
    calls = []
    held = V.sample_vectors(cells, KEYS, embedder(calls)).collect()
    want = {(r.chunk_id, t) for r in cells.collect() for t in (r.txt, r.col, r.target_text, r.target_column) if t is not None}
    assert len(calls) == len(set(calls)) == len({t for _, t in want})
    ids = {r.text_id: r.txt for r in X.distinct_texts(spark.createDataFrame([(t,) for t in {t for _, t in want}], "txt string")).collect()}
    got = [(r.chunk_id, ids[r.text_id]) for r in held]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(r.vec[0] == len(ids[r.text_id]) and abs(r.vec[1] - 1 / 3) < 1e-7 and r.vec[1] != 1 / 3 for r in held)  # floats


def test_inline_vectors_keep_every_cell(spark, cells):
    out = V.inline_vectors(cells, V.sample_vectors(cells, KEYS, embedder([])), KEYS)
    assert set(out.columns) == {*cells.columns, *[f"{c}_vec" for c in V.PLACES]}
    rows = out.collect()
    assert len(rows) == 4000 and len({r.row_ord for r in rows}) == 4000
    for r in rows:
        for c in V.PLACES:
            text, vec = r[c], r[f"{c}_vec"]
            assert (vec is None) == (text is None) and (vec is None or vec[0] == len(text))


def test_known_texts_are_not_embedded_again(spark, cells):
    calls = []
    known = embedder([])(X.distinct_texts(cells.where("txt = 'common words' or txt = ''")))
    held = V.sample_vectors(cells, KEYS, embedder(calls), known)
    assert held.where("vec is null").count() == 0
    assert not {"common words", ""} & set(calls) and {"col a", "label", "the target"} < set(calls)


def test_no_cells_and_no_texts(spark, cells):
    none = cells.limit(0)
    assert V.sample_vectors(none, KEYS).count() == 0
    bare = cells.drop("target_column").withColumns({c: F.lit(None).cast("string") for c in ("txt", "col", "target_text")})
    vectors = V.sample_vectors(bare, KEYS)
    assert vectors.count() == 0 and vectors.schema["vec"].dataType.simpleString() == "array<float>"
    assert V.inline_vectors(bare, vectors, KEYS).where("txt_vec is null and col_vec is null").count() == 4000


def texts_of(spark, *texts):
    return X.text_counts(spark.createDataFrame([(t,) for t in texts], "txt string"))


def test_dictionary_grows_by_committed_versions(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "dictionary"), []
    assert D.known_vectors(spark, path).count() == 0
    assert D.grow_dictionary(spark, path, texts_of(spark, "a", "bb", None, "", "a"), embedder(calls), "one") == 3
    assert D.grow_dictionary(spark, path, texts_of(spark, "bb", "ccc"), embedder(calls), "two") == 1
    assert D.grow_dictionary(spark, path, texts_of(spark, "a", "bb", "ccc"), embedder(calls)) == 0
    assert D.grow_dictionary(spark, path, texts_of(spark, "dddd"), embedder(calls), "two") == 0  # committed already
    assert sorted(calls) == ["", "a", "bb", "ccc"]

    def dies(texts):
        embedder(calls)(texts).write.parquet(f"{path}/vectors/version=three")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        D.grow_dictionary(spark, path, texts_of(spark, "dddd"), dies, "three")
    assert D.known_vectors(spark, path).count() == 4  # what is not committed is not read
    assert D.grow_dictionary(spark, path, texts_of(spark, "dddd", "e" * 5), embedder(calls), "three") == 2
    got = D.known_vectors(spark, path).collect()
    assert sorted((int(r.vec[0]), r.version) for r in got) == [(0, "one"), (1, "one"), (2, "one"), (3, "two"), (4, "three"), (5, "three")]
    with pytest.raises(ValueError):
        D.grow_dictionary(spark, path, texts_of(spark, "x"), version="a/b")


def test_two_writers_leave_one_vector_for_each_text(spark, tmp_path):
    path = str(tmp_path / "raced")

    def other(texts):  # the second writer begins and ends while the first one embeds
        if not D.versions(spark, path).count():
            assert D.grow_dictionary(spark, path, texts_of(spark, "a", "bb"), embedder([]), "w2") == 2
        return embedder([])(texts)

    assert D.grow_dictionary(spark, path, texts_of(spark, "a", "ccc"), other, "w1") == 2
    got = sorted((int(r.vec[0]), r.version) for r in D.known_vectors(spark, path).collect())
    assert got == [(1, "w1"), (2, "w2"), (3, "w1")]
    vectors = V.sample_vectors(
        spark.createDataFrame([("t", 0, "a", "bb", None), ("t", 0, None, "ccc", None)], "table_id string, chunk_id long, txt string, col string, target_text string"),
        KEYS, embedder([]), D.known_vectors(spark, path).select("text_id", "vec"),
    )
    assert sorted(int(r.vec[0]) for r in vectors.collect()) == [1, 2, 3]
