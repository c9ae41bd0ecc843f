"""Sample output."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

LAYOUT = ("task", "stage", "epoch")


def write_samples(samples, path, shard=None):
    """Write samples by task, stage and epoch, replacing just the partitions they fall in, and give
    back what this run wrote.

    Runs that each write a part of the same epochs name their ``shard``: it is a further partition
    level, so that one run never replaces what another wrote. Classification targets are integers,
    regression targets floats: both typed columns exist and the other one is null. Raises when this
    run produced no sample, whatever lies below the path already.
    """
    typed, layout = samples, list(LAYOUT)
    if shard is not None:
        typed, layout = typed.withColumn("shard", F.lit(shard)), [*layout, "shard"]
    if "target" in samples.columns:
        is_reg = F.col("task") == "regression"
        typed = typed.withColumn(
            "target_int", F.when(~is_reg, F.col("target")).cast("int")
        ).withColumn("target_float", F.when(is_reg, F.col("target")).cast("float"))
        typed = typed.drop("target")
    seen = Observation()
    # One hash per partition written: rows are told apart by a number, partitions are few.
    place = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in layout])
    (
        typed.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(place).alias("places"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*layout)
        .parquet(path)
    )
    if not seen.get["n"]:
        raise ValueError(f"no eligible samples were produced for {path}")
    written = samples.sparkSession.read.schema(typed.schema).parquet(path)
    return written.where(place.isin(seen.get["places"]))
