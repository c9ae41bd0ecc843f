"""A corpus of tables to encoded samples, with targets chosen automatically or fixed.

Each file is planned once from its footer and read once: the tables of one schema, target column and task
are the splits of one scan, chosen by path, and what decides on a chunk (is its target usable, is
its text valid) are windows over the exchange that the sample needs anyway.
"""

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Optional

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.channels import DATE, NUM, TIME, channel_value, kinds
from ..operators import sampling as S
from ..operators import targets as G
from ..operators.ranking import bounded
from ..sources import corpus, manifest, scan
from ..sources.guards import valid_chunk
from ..sources.shared import fresh_path, stage
from .encode_sample import encode
from .prepare import SampleConfig, prepare

KEYS = ("table_id", "chunk_id", "replica")


@dataclass
class Encoding:
    """How cells and targets are encoded."""

    regression: str = "bins"
    classification: str = "cross-entropy"
    mode: str = "valid"
    bins: int = K.NUM_BINS
    scale: Optional[int] = None
    label_vector: Optional[Callable] = None


def corpus_samples(spark, root, config=None, encoding=None, shard=(0, 1), epoch=0, plan=None):
    """Encoded cells of every sample of a corpus.

    One row per (table_id, chunk_id, replica, row_ord, feature) with path, target column, task and
    query chunk. Shards only select tables: draws are keyed by table, so a sample is the same in
    any sharding. ``epoch`` shifts the seed. ``plan``: a ``plan_corpus`` of the shard's tables, to use
    it again for further epochs and to ask it afterwards what was ``skipped``.
    """
    config, encoding = config or SampleConfig(), encoding or Encoding()
    config = replace(config, seed=config.seed + epoch)
    size = scan.chunk_size(
        config.min_rows, config.max_rows, config.query_range, config.rows_per_chunk
    )
    if config.auto_target and size < K.MIN_PROBE_ROWS:
        raise ValueError(f"chunks of {size} rows are below the probe minimum: no table can qualify")
    plan = plan or plan_shard(spark, root, shard)
    tables = manifest.one_path(plan.splits)
    chosen = _auto(plan, tables, size, config) if config.auto_target else _fixed(plan, tables, config)
    parts = [_encoded(plan, size, config, encoding, *c) for c in chosen]
    parts = [p for p in parts if p is not None]
    if not parts:
        raise ValueError(f"no eligible table below {root}")
    return scan.union_all(parts).join(tables, "table_id")


def plan_shard(spark, root, shard=(0, 1)):
    """The plan of a shard's tables; raises where the root holds none."""
    tables = manifest.with_ordinal(manifest.list_tables(spark, root))
    if tables.isEmpty():
        raise FileNotFoundError(f"no {manifest.SUFFIX} files below {root}")
    return corpus.plan_corpus(spark, root, manifest.shard(tables, *shard))


def _auto(plan, tables, size, config):
    """(schema, splits written, which of them, rows, specs, their number, column, task) by chosen targets."""
    cells = corpus.probe_cells(plan, size, config.min_rows, config.times)
    specs = G.build_specs(
        cells, tables, config.seed, K.MIN_PROBE_ROWS, config.max_features, config.keyword, config.balanced
    )
    specs = stage(specs.select("table_id", "col", "task", "replica"), "specs")
    total = specs.count()
    at, placed = _written(plan.readable().join(specs.select("table_id", "col", "task").distinct(), "table_id"))
    schemas = dict(plan.schemas())
    # A spec names a column of its schema, so there are at most as many groups as distinct columns.
    for *g, rows in _groups(placed, specs, "schema_key", "col", "task"):
        key, column, task = g
        own = (F.col("col") == column) & (F.col("task") == task)
        yield schemas[key], at, {"schema_key": key, "col": column, "task": task}, rows, specs.where(own), total, column, task


def _fixed(plan, tables, config):
    by_path = G.infer_task(tables, config.keyword, by_path_only=True)
    by_path = by_path.withColumn("replica", F.lit(0).cast("bigint")).drop("path")
    at, placed = _written(plan.readable().join(by_path.select("table_id", "task"), "table_id"))
    schemas = dict(plan.schemas())
    # At most two tasks for each schema.
    for key, task, rows in _groups(placed, by_path, "schema_key", "task"):
        schema = schemas[key]
        column = G.resolve_target(schema.names, config.target)
        yield schema, at, {"schema_key": key, "task": task}, rows, by_path.where(F.col("task") == task), None, column, task


def _groups(placed, specs, *by):
    """Sorted groups of splits with the rows of their samples, by the footers; a split counts once a spec."""
    replicas = specs.groupBy("table_id").agg(F.count(F.lit(1)).alias("_k"))
    rows = F.sum(F.col("n_rows") * F.col("_k")).alias("rows")
    return sorted(map(tuple, placed.join(replicas, "table_id").groupBy(*by).agg(rows).collect()))


def _written(splits):
    path = fresh_path(splits.sparkSession, "placed")
    splits.write.parquet(path)
    return path, splits.sparkSession.read.schema(splits.schema).parquet(path)


def _encoded(plan, size, config, encoding, schema, at, which, n_rows, specs, n_specs, column, task):
    """Samples of the tables whose spec names this schema, column and task."""
    kind = kinds(schema, config.times)[column]
    numeric = isinstance(schema[column].dataType, T.NumericType)
    if config.skip_ineligible and (kind in (DATE, TIME) or (task == "regression" and not numeric)):
        return None
    if config.skip_ineligible and (kind == NUM) != (task == "regression"):
        return None
    picked = bounded(specs.select("table_id", "replica"), n_specs)
    rows = corpus.read_rows(plan, which, schema, size, config.min_rows, at=at).join(picked, "table_id")
    # Any task of a branch compiles it anew when the code of many branches does not fit the cache: few tasks.
    rows = S.deal_samples(rows, ("chunk_id", "table_id", "replica"), n_rows=n_rows)
    usable = valid_chunk(rows, KEYS)
    if config.skip_ineligible:
        usable = usable & _eligible(schema, column, kind, config)
    prepared, kind = prepare(rows, column, config, KEYS, usable)
    if prepared is None:
        return None
    cells = encode(
        prepared, kind, column, task, KEYS, encoding.regression, encoding.classification,
        encoding.mode, config.seed, encoding.bins, encoding.scale, encoding.label_vector,
    )
    chunk = S.query_chunk_of(config.query_chunk)
    return (
        cells.withColumn("query_chunk", F.when(F.col("is_query"), chunk).cast("bigint"))
        .withColumn("target_column", F.lit(column))
        .withColumn("task", F.lit(task))
        .drop("fit_rows")
    )


def _eligible(schema, column, kind, config):
    """Whether a chunk's target has values, and in fixed mode few nulls or few classes, as a window."""
    chunk = S.whole(KEYS)
    value = channel_value(column, schema[column].dataType, kind)
    present, rows = F.count(value).over(chunk), F.count(F.lit(1)).over(chunk)
    if config.auto_target:
        return present > 0
    if kind == NUM:
        return (present > 0) & (rows - present <= config.max_null * rows)
    # Values of one chunk: bounded by its rows.
    return (present > 0) & (F.size(F.collect_set(value).over(chunk)) <= config.max_distinct * rows)
