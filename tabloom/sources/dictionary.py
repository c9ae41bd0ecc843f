"""A dictionary of text vectors on disk that grows by versions.

Each run adds the texts that are missing as a version of its own, in a folder of its own, and then commits
it. Versions are never changed. A run that dies leaves a version without a commit, which is not read
and is replaced by the next run of that name. Runs may overlap: both may add a text, and readers take
it from the version that comes first by name.

Readers group by text id, which is how the rows are joined later, so that costs no further exchange.
"""

import uuid

from pyspark.sql import functions as F

from ..operators import text as X
from .shared import stage

COMMIT = "n_texts long, version string"
VECTORS = "text_id string, vec array<float>, version string"


def versions(spark, path):
    """(n_texts, version) of the committed versions."""
    spark.createDataFrame([], "n_texts long").write.mode("ignore").parquet(f"{path}/commits")
    return spark.read.schema(COMMIT).option("basePath", f"{path}/commits").parquet(f"{path}/commits")


def _committed(spark, path):
    names = sorted(r.version for r in versions(spark, path).select("version").collect())  # one per run
    if not names:
        return spark.createDataFrame([], VECTORS)
    folders = [f"{path}/vectors/version={name}" for name in names]
    return spark.read.schema(VECTORS).option("basePath", f"{path}/vectors").parquet(*folders)


def known_vectors(spark, path):
    """(text_id, vec, version) of every text of the committed versions, once."""
    first = F.min_by(F.struct("vec", "version"), "version").alias("f")
    return _committed(spark, path).groupBy("text_id").agg(first).select("text_id", "f.*")


def grow_dictionary(spark, path, texts, embed=X.hash_embed, version=None):
    """Embed the texts (text_id, txt) that no committed version has; gives back how many.

    ``version`` names the run (letters, digits, ``-``, ``_`` and ``.``): a name that is committed already
    adds nothing, so that a repeated run is harmless. Null texts have no entry; repeated ones have one.
    """
    version = version or uuid.uuid4().hex
    if not version.replace("-", "").replace("_", "").replace(".", "").isalnum():
        raise ValueError(f"no name for a version: {version!r}")
    if not versions(spark, path).where(F.col("version") == version).isEmpty():
        return 0
    own = texts.where("txt is not null").groupBy("text_id").agg(F.any_value("txt").alias("txt"))
    missing = stage(X.missing_texts(own, _committed(spark, path)), "missing-texts")
    n = missing.count()
    if n:
        vectors = embed(missing).select("text_id", F.col("vec").cast("array<float>").alias("vec"))
        vectors.write.mode("overwrite").parquet(f"{path}/vectors/version={version}")
        done = spark.range(1).select(F.lit(n).cast("bigint").alias("n_texts"))
        done.write.mode("overwrite").parquet(f"{path}/commits/version={version}")
    return n
