"""Epochs of a corpus, written stage by stage and shard by shard.

A run writes one shard of the tables: for each stage and epoch its samples, then a commit that says
what was written. Only committed samples are read back. A run that dies leaves samples without a
commit, which the next run of that shard replaces; what is committed is not computed again. Draws are
keyed by table, so attempts write the same rows and may overlap.
"""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..sources.sink import LAYOUT, write_samples
from .corpus import Encoding, corpus_samples, plan_shard
from .prepare import SampleConfig

PLACE = (*LAYOUT, "shard")
COMMIT = "n_cells long, n_rows long, n_query long, target_sum double, task string, stage string, epoch int, shard string"


@dataclass
class Stage:
    """One stage of training data: how its samples are made and how often the corpus is read."""

    name: str
    config: SampleConfig
    epochs: int = 1
    encoding: Encoding = field(default_factory=Encoding)


def commits(spark, path):
    """One row for each task, stage, epoch and shard that was written to its end."""
    spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(f"{path}/commits")
    return spark.read.schema(COMMIT).parquet(f"{path}/commits")


def _commit(written, path):
    first = F.col("col_pos") == 0  # the first cell of each row
    target = F.when(first & (F.col("task") == "regression"), F.col("target_float"))
    target = F.when(first & (F.col("task") != "regression"), F.col("target_int")).otherwise(target)
    done = written.groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(first).alias("n_rows"),
        F.count_if(first & F.col("is_query")).alias("n_query"),
        F.sum(F.when(~F.col("is_query"), target.cast("double"))).alias("target_sum"),
    )
    layout = ("stage", "epoch", "shard")  # the tasks of one shard are committed together
    done = done.withColumn("epoch", F.col("epoch").cast("int")).repartition(1)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(f"{path}/commits")


def write_epochs(spark, root, path, stages, shard=(0, 1)):
    """Write what is missing of one shard's epochs below ``path`` and give back its commits.

    ``shard``: (index, number of shards). All runs below one path use the same number of shards; another
    one is refused, since tables would be written twice. The corpus is planned once per run.
    """
    names = [s.name for s in stages]
    if len(set(names)) < len(names):
        raise ValueError(f"stages share a name: {names}")
    index, count = shard
    name = f"{index:05d}-of-{count:05d}"
    done = commits(spark, path)
    others = done.where(~F.endswith("shard", F.lit(f"-of-{count:05d}"))).select("shard").first()
    if others:
        raise ValueError(f"{path} holds shard {others.shard}; it cannot take shard {name}")
    own = done.where(F.col("shard") == name)
    held = {(r.stage, r.epoch) for r in own.select("stage", "epoch").distinct().collect()}
    plan = None
    for stage in stages:
        for epoch in range(stage.epochs):
            if (stage.name, epoch) in held:
                continue
            plan = plan or plan_shard(spark, root, shard)
            samples = corpus_samples(spark, root, stage.config, stage.encoding, shard, epoch, plan)
            samples = samples.withColumns({"stage": F.lit(stage.name), "epoch": F.lit(epoch)})
            _commit(write_samples(samples, f"{path}/samples", name), path)
    return commits(spark, path).where(F.col("shard") == name)


def read_epochs(spark, path):
    """The committed samples below ``path``; partitions without a commit are not read."""
    samples = spark.read.parquet(f"{path}/samples")
    done = commits(spark, path).select(*PLACE).distinct()
    # One short row per task, stage, epoch and shard.
    return samples.join(F.broadcast(done), list(PLACE), "left_semi")
