"""Paths all executors can reach, for checkpoints and tables written between stages."""

import tempfile
import uuid


def shared_dir(spark):
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one.

    The fallback serves single-machine sessions such as tests only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="tabloom-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def fresh_path(spark, name):
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df, name):
    """Write a frame below the shared folder and read it back: computed once, lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
