"""Corpus discovery: which Parquet tables lie below a root, in which order, with which schema."""

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.ranking import bucketed_rank
from .shared import stage

SUFFIX = ".parquet"


def _check_root(spark, root):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(hadoop)
    if not fs.exists(path):
        raise FileNotFoundError(f"no such corpus root: {root}")
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"corpus root is not a directory: {root}")
    return fs.makeQualified(path).toString().rstrip("/")


def root_path(root):
    """The path part of a qualified root, without scheme and host."""
    rest = root.split("://", 1)[1] if "://" in root else root
    if "://" in root:
        return "/" + rest.split("/", 1)[1] if "/" in rest else ""
    return "/" + rest.split(":", 1)[-1].lstrip("/")


def below(path, root, encoded=False):
    """SQL text for the part of a path below the root.

    ``path`` is SQL text. Plain substring work, since it runs once per row; ``encoded`` paths, as
    the file metadata column has them, are decoded only where they hold an escape.
    """
    lead = root_path(root) + "/"
    lit = lead.replace("\\", "\\\\").replace("'", "\\'")
    if encoded:
        path = f"if(contains({path}, '%'), url_decode(replace({path}, '+', '%2B')), {path})"
    return f"substring({path}, instr({path}, '{lit}') + {len(lead)})"


def table_id_of(path, root, encoded=False):
    """Table identity: the path below the root without its suffix.

    A folder with the suffix is one table, whose files are its parts in path order.
    """
    return F.expr(f"substring_index(concat({below(path, root, encoded)}, '/'), '{SUFFIX}/', 1)")


def list_tables(spark, root):
    """(table_id, path, length) of every Parquet file below root, at any depth. Reads no file content."""
    base = _check_root(spark, root)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*" + SUFFIX)
        .load(root)
        .select("path", "length")
    )
    return files.select(table_id_of("path", base).alias("table_id"), "path", "length")


def with_ordinal(tables):
    """Position of each table in path order, components compared one by one.

    Replacing the separator by the lowest code point turns that order into plain string order.
    Tables are bucketed by the leading characters of their path, so no task sorts all of them
    unless all share one prefix.
    """
    key = F.translate("table_id", "/", "\u0001")
    keyed = tables.select("table_id").distinct().withColumn("_key", key).withColumn("_all", F.lit(0))
    ranked = bucketed_rank(keyed, ["_all"], F.substring("_key", 1, 3), [F.col("_key")], "ord")
    return tables.drop("length").join(ranked.drop("_key", "_all"), "table_id")


def one_path(files, *more):
    """(table_id, more columns, path) of each table: its file, or the folder that holds its parts."""
    folder = F.regexp_replace(F.min("path"), "/[^/]*$", "")
    path = F.when(F.min("path") == F.max("path"), F.min("path")).otherwise(folder)
    return files.groupBy("table_id", *more).agg(path.alias("path"))


def footer_rows(spark, root):
    """(table_id, path, n_rows, reason) of each file, read from its footer once: the row count, or why there is none.

    Errors go by the rule of ``corpus``: what is wrong in a file is a reason, a store that is away fails the job.
    """
    files = list_tables(spark, root)

    def counted(batches):
        from .corpus import attempt, opened

        for batch in batches:
            table_id, path = batch.columns
            found = [attempt(p, lambda p=p: opened(p).metadata.num_rows) for p in path.to_pylist()]
            rows, reason = pa.array([n for n, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string())
            yield pa.RecordBatch.from_arrays([table_id, path, rows, reason], ["table_id", "path", "n_rows", "reason"])

    shape = "table_id string, path string, n_rows long, reason string"
    return stage(files.select("table_id", "path").mapInArrow(counted, shape), "footers")


def table_rows(spark, root):
    """(table_id, n_rows) of every table below root, those without rows too, from the file footers.

    A file that cannot be read is an error: left out, or counted as empty, it would look like a result.
    """
    files = footer_rows(spark, root)
    broken = files.where("reason is not null").orderBy("path").select("path", "reason").take(5)
    if broken:
        raise ValueError("; ".join(f"cannot read {r.path}: {r.reason}" for r in broken))
    if files.isEmpty():
        raise FileNotFoundError(f"no {SUFFIX} files below {root}")
    return files.groupBy("table_id").agg(F.sum("n_rows").alias("n_rows"))


def manifest(spark, root):
    """One row per table: (table_id, path, ord, n_rows, reason); raises when there is none.

    A file that cannot be read adds no rows; ``reason`` says why, and is null for tables read whole.
    """
    tables = list_tables(spark, root)
    if tables.isEmpty():
        raise FileNotFoundError(f"no {SUFFIX} files below {root}")
    counts = footer_rows(spark, root).groupBy("table_id").agg(F.sum("n_rows").alias("n_rows"), F.min("reason").alias("reason"))
    return (
        one_path(with_ordinal(tables), "ord")
        .join(counts, "table_id", "left")
        .select("table_id", "path", "ord", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "reason")
    )


def shard(tables, index, count):
    """Every count-th table starting at index, by ordinal."""
    if count <= 0:
        raise ValueError("the number of shards must be positive")
    if not 0 <= index < count:
        raise ValueError("the shard index must lie in [0, number of shards)")
    return tables.where(F.pmod(F.col("ord"), F.lit(count)) == index)


def replicate_epochs(specs, epochs, seed):
    """One copy of each spec per epoch, carrying the seed of that epoch (seed + epoch)."""
    if epochs < 1:
        raise ValueError("at least one epoch is needed")
    copies = specs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return copies.withColumn("epoch_seed", (F.col("epoch") + F.lit(seed)).cast("bigint"))


def epoch_plan(stages, seed):
    """Epoch copies of every stage. ``stages``: (name, specs, rows per sample, epochs) tuples."""
    parts = [
        replicate_epochs(specs, epochs, seed)
        .withColumn("stage", F.lit(name))
        .withColumn("rows_per_sample", F.lit(rows).cast("bigint"))
        for name, specs, rows, epochs in stages
    ]
    plan = parts[0]
    for part in parts[1:]:
        plan = plan.unionByName(part)
    return plan
