"""Text dictionary: each distinct text is embedded once and joined back to its cells."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..sources.shared import stage
from .ranking import bounded

DIMS = 64
HOT_SHARE = 1000  # a text on more than 1/1000 of all cells counts as hot


def text_id(txt):
    """Key of a text. Long texts are joined and grouped by it, not shuffled themselves."""
    return F.sha2(F.col(txt) if isinstance(txt, str) else txt, 256)


def text_counts(cells, txt="txt"):
    """(text_id, txt, n) of the distinct texts; hot texts combine before the shuffle."""
    present = cells.where(F.col(txt).isNotNull())
    return present.groupBy(text_id(txt).alias("text_id")).agg(
        F.any_value(txt).alias("txt"), F.count(F.lit(1)).alias("n")
    )


def distinct_texts(cells, txt="txt"):
    return text_counts(cells, txt).select("text_id", "txt")


def missing_texts(texts, dictionary):
    """Texts without an entry in the dictionary: the only ones to embed."""
    return texts.join(dictionary.select("text_id"), "text_id", "left_anti")


def tokens(txt):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(txt), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def hash_embed(texts, txt="txt", dims=DIMS, seed=0):
    """(text_id, vec): token counts hashed to dims buckets, at unit length. Needs no model.

    One token per row, combined per (text, bucket) before the shuffle, so a text of any length
    leaves at most dims rows. A text without tokens gets the zero vector.
    """
    tok = texts.select("text_id", F.explode_outer(tokens(F.col(txt))).alias("_t"))
    slot = F.when(F.col("_t").isNotNull(), draw(seed, "token", "_t") % dims)
    counts = tok.groupBy("text_id", slot.cast("int").alias("_b")).agg(
        F.count("_t").cast("double").alias("_n")
    )
    one = counts.groupBy("text_id").agg(
        F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"),
        F.map_from_entries(
            F.filter(F.collect_list(F.struct("_b", "_n")), lambda s: s["_b"].isNotNull())
        ).alias("_m"),
    )
    at = lambda i: F.coalesce(F.try_element_at("_m", i) / F.col("_norm"), F.lit(0.0))
    return one.select("text_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at).alias("vec"))


def embed_with(texts, make_embedder, txt="txt", batch=512):
    """(text_id, vec) from a user embedder.

    ``make_embedder()`` is called once per Python worker and returns a function from a list of at
    most ``batch`` texts to a list of vectors.
    """

    def run(frames):
        embed = make_embedder()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = embed(part[txt].tolist())
                out = part[["text_id"]].copy()
                out["vec"] = [[float(x) for x in v] for v in vectors]
                yield out

    return texts.select("text_id", txt).mapInPandas(run, "text_id string, vec array<double>")


def extend_dictionary(dictionary, texts, embed=hash_embed):
    """The dictionary with the missing texts embedded and added."""
    return dictionary.unionByName(embed(missing_texts(texts, dictionary)))


def attach_text(cells, dictionary, txt="txt"):
    """Vector of each cell's text, as ``vec``."""
    return attach_vectors(cells.withColumn("text_id", text_id(txt)), dictionary).drop("text_id")


def attach_vectors(keyed, dictionary):
    """Rows with a text_id and the vector of that text, as ``vec``.

    Texts on more than 1/1000 of the rows are at most 1000; they are joined by broadcast and
    their rows never shuffle. All other texts are joined by key, none of them hot. The rows are
    counted by text once.
    """
    counts = stage(keyed.groupBy("text_id").agg(F.count(F.lit(1)).alias("_n")), "text-counts")
    hot = counts.where(F.col("_n") * HOT_SHARE > counts.agg(F.sum("_n")).scalar())
    hot = bounded(hot.where("text_id is not null").select("text_id"), HOT_SHARE)
    hot_vectors = F.broadcast(dictionary.join(hot, "text_id", "left_semi"))
    head = keyed.join(hot, "text_id", "left_semi").join(hot_vectors, "text_id", "left")
    tail = keyed.join(hot, "text_id", "left_anti").where("text_id is not null").join(dictionary, "text_id", "left")
    none = keyed.where("text_id is null").withColumn("vec", F.lit(None).cast(dictionary.schema["vec"].dataType))
    return head.unionByName(tail).unionByName(none)


def first_occurrence(rows, value, keys=("table_id", "chunk_id"), row="row_ord"):
    """Distinct values of each sample with first position and ordinal of appearance."""
    first = rows.groupBy(*keys, value).agg(F.min(row).alias("first_row"))
    w = W.partitionBy(*keys).orderBy("first_row")
    return first.withColumn("ordinal", (F.row_number().over(w) - 1).cast("bigint"))


def disambiguate_labels(rows, label, vec, keys=("table_id", "chunk_id"), row="row_ord"):
    """Label texts per sample, told apart where their vectors collide.

    Fewer distinct vectors than labels: every label text becomes ``ordinal_label``, with the
    ordinal of its first appearance. Returns (keys, label, ordinal, collides, label_text).
    """
    first = rows.groupBy(*keys, label).agg(
        F.min(row).alias("_first"), F.any_value(vec).alias("_vec")
    )
    whole = W.partitionBy(*keys)
    ordinal = (F.row_number().over(whole.orderBy("_first")) - 1).cast("bigint")
    out = (
        first.withColumn("ordinal", ordinal)
        .withColumn("_labels", F.count(F.lit(1)).over(whole))
        .withColumn("_vectors", F.size(F.collect_set("_vec").over(whole)))
        .withColumn("collides", F.col("_vectors") < F.col("_labels"))
    )
    text = F.when(F.col("collides"), F.concat_ws("_", F.col("ordinal").cast("string"), F.col(label)))
    return out.select(
        *keys, label, "ordinal", "collides", F.coalesce(text, F.col(label)).alias("label_text")
    )


def pool(tokens_, keys, method="mean", vec="vec", pos="pos", mask="mask"):
    """One vector per text from its token vectors: masked mean, or the first token.

    The mean divides by the number of unmasked tokens, at least 1e-9.
    """
    if method == "cls":
        return tokens_.groupBy(*keys).agg(F.min_by(vec, pos).alias("vec"))
    if method != "mean":
        raise ValueError(f"unknown pooling method {method!r}")
    m = F.col(mask).cast("double")
    spread = tokens_.select(*keys, m.alias("_m"), F.posexplode(vec).alias("_d", "_x"))
    per_dim = spread.groupBy(*keys, "_d").agg(
        (
            F.sum(F.col("_x").cast("double") * F.col("_m"))
            / F.greatest(F.sum("_m"), F.lit(1e-9))
        ).alias("_v")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_d", "_v")))
    return per_dim.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_v"]).alias("vec"))
