"""The pipeline's stages on rows that share ids, are empty or carry columns named like work columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import decontaminate, jaccard, langid, mixing, quality, tokens
from tabloom.llm.queries import mix_plan, vocabulary

CLASHING = ("_words _lines _left _clean kept n_words text_key n_hit spans _cut _pieces _full _rest _buckets _draw _bucket _end _before "
            "_upto _budget _md5 _node0 n_tokens epoch domain _id _key _nth _keep_id `a.b`").split()


def sentences(seed, n=70):
    return " ".join(f"word{(seed * 7919 + i * i) % 997} of," if i % 9 else f"end{i + seed}.\nNext" for i in range(n)) + " done."


@pytest.fixture(scope="module")
def docs(spark):
    a, b = sentences(1), sentences(2)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, sentences(3)), (None, sentences(3)), (None, sentences(4)), (6, None), (7, ""),
            (7, ""), (8, sentences(5, 3000)), (9, sentences(5, 3000) + " more"), (10, "word " * 200)]
    rows = [(i, t, "en" if (i or 0) % 2 else None, "src3", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("own " + c.strip("`")).alias(c.strip("`")) for c in CLASHING])


def shape(df):
    own = [c.strip("`") for c in CLASHING]
    rows = df.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in own)
    return sorted((str(r.doc_id), r.text or "") for r in rows)


def test_one_document_of_each_group_by_row_and_not_by_id(docs):
    a, b, c, d = (sentences(i) for i in (1, 2, 3, 4))
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    got = shape(kept)
    want = [("1", a), ("5", b), ("None", c), ("None", d), ("6", ""), ("7", ""), ("8", sentences(5, 3000)), ("10", "word " * 200)]
    assert got == sorted(want)


def test_stages_pass_columns_of_any_name(spark, docs):
    items = spark.createDataFrame([("x", " ".join(sentences(2).split()[:12]))], "item_id string, text string")
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns and {i for i, _ in shape(clean)} == {"1", "5", "None"}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sentences(2) not in {t for _, t in shape(left)}
    cut = decontaminate.cut_spans(docs, items)
    assert cut.columns == docs.columns and len(shape(cut)) == docs.count()
    plan = mix_plan("_mix_")
    mixed = mixing.mix_documents(docs, plan)
    assert mixed.columns == docs.columns and set(shape(mixed)) <= set(shape(docs)) and mixed.count()
    scored = quality.score_lines(docs)
    assert {r[0] for r in scored.select("_words").collect()} == {"own _words"}
    assert decontaminate.mark_documents(docs, items).filter("contaminated").count() == 2


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, docs, empty, monkeypatch):
    given = docs.limit(0) if empty else docs
    items = spark.createDataFrame([("x", "no such words at all here")], "item_id string, text string")
    tables = {"documents": given, "benchmark": items}
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: tables[name])
    got = corpus_pipeline.run(spark, "nowhere").collect()
    if empty:
        assert got == []
        return
    encoder = tokens.encoder(vocabulary())
    counts = {len(x) // 4 for x in encoder.encode([sentences(i) for i in (1, 2, 3, 4)] + [sentences(5, 3000)])}
    assert got and {r.n_tokens for r in got} <= counts


def test_signs_that_are_no_letters_have_no_language(spark):
    rows = [(i, f"the of and {i} with words", "en") for i in range(40)] + [(99, "½ ² 3 ① Ⅷ", None), (98, "é", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[99].lang_pred, got[99].score) == ("und", 0.0) and got[98].lang_pred == "en"


def test_entry_works_without_a_library_of_the_optional_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("tabloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    try:
        names = importlib.reload(__spark_entry__).queries()
        assert "quantile_bin" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_encoder_checks_its_pre_tokenizer():
    assert tokens.encoder(vocabulary()).cuts
    import public_tokenizers

    other = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.cuts
    texts = ["Some words, cut. Not\nhere", "", "x"]
    assert other.encode(texts) == [x + bytes(4) for x in other.ids(texts)]
