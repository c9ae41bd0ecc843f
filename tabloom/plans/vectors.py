"""Vectors of the texts in encoded samples: cell texts, column names and labels.

Cells carry text ids; the vectors lie beside them, one row per sample and distinct text, in single
precision. A column name or a common value is thus held once a sample rather than once a cell, and the
join with the dictionary moves the distinct texts of samples, never the cells. A text of many samples
is joined by broadcast (see ``attach_text``), and each distinct text is embedded once.
"""

from pyspark.sql import functions as F

from ..operators import text as X
from ..sources.shared import stage

PLACES = ("txt", "col", "target_text", "target_column")


def with_text_ids(cells):
    """Cells with the id of each text they show: ``txt_id``, ``col_id``, ``target_text_id`` and, where
    the target column is named, ``target_column_id``; null where there is no text."""
    return cells.withColumns({f"{c}_id": X.text_id(c) for c in PLACES if c in cells.columns})


def sample_texts(cells, keys):
    """(keys, text_id, txt): each distinct text of a sample once."""
    shown = F.array(*[F.col(c) for c in PLACES if c in cells.columns])
    texts = cells.select(*keys, F.explode(F.array_distinct(F.array_compact(shown))).alias("txt"))
    found = texts.groupBy(*keys, X.text_id("txt").alias("text_id"))
    return found.agg(F.any_value("txt").alias("txt"))


def sample_vectors(cells, keys, embed=X.hash_embed, dictionary=None):
    """(keys, text_id, vec): a vector of floats for each distinct text of each sample.

    ``cells`` is read once. ``embed`` takes (text_id, txt) and gives (text_id, vec); it sees the texts
    that ``dictionary`` (text_id, vec) lacks, once each. A sample without texts has no rows.
    """
    held = stage(sample_texts(cells, keys), "sample-texts")
    texts = X.distinct_texts(held)
    known = embed(texts) if dictionary is None else X.extend_dictionary(dictionary, texts, embed)
    known = stage(known.select("text_id", F.col("vec").cast("array<float>").alias("vec")), "vectors")
    return X.attach_vectors(held.drop("txt"), known)


def inline_vectors(cells, vectors, keys):
    """Cells with ``txt_vec``, ``col_vec``, ``target_text_vec`` (and ``target_column_vec``) themselves.

    Much larger than cells and vectors apart: for a part of the samples, or for consumers that
    cannot look vectors up. Joins go by sample and text, so no text is hot.
    """
    out = with_text_ids(cells)
    for c in PLACES:
        if c in cells.columns:
            own = vectors.withColumnsRenamed({"text_id": f"{c}_id", "vec": f"{c}_vec"})
            out = out.join(own, [*keys, f"{c}_id"], "left").drop(f"{c}_id")
    return out
