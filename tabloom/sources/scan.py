"""Table scans: row ordinals, chunks, probe chunks and the long cell relation."""

import base64

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import PySparkTypeError
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.channels import DATE, NUM, TEXT, TIME, channel_sql, kinds
from .manifest import _check_root, below, table_id_of

ROW_COLUMNS = ("table_id", "chunk_id", "row_ord")


def scan(spark, root, paths=None, schema=None, starts=None):
    """Rows of the given files (default: all below root, one schema) with table_id and row_ord.

    row_ord is the position of the row in its file, straight from the Parquet reader, plus the file's
    start in ``starts``: (path, start) of the parts that are not the first of their table.
    """
    base = _check_root(spark, root)
    reader = spark.read.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema).option("ignoreCorruptFiles", "true")
    rows = reader.parquet(*(paths or [root]))
    table = table_id_of("_metadata.file_path", base, encoded=True)
    place, columns = F.col("_metadata.row_index"), [F.col(f"`{c}`") for c in rows.columns]
    if starts is not None:
        part = F.expr(below("_metadata.file_path", base, encoded=True))
        rows = rows.withColumns({"_part": part, "_row": place, "_table": table})
        parts = starts.select(F.expr(below("path", base)).alias("_part"), F.col("start").alias("_start"))
        # One short row per file, whose paths the driver knows already.
        rows = rows.join(F.broadcast(parts), "_part", "left")
        table, place = F.col("_table"), F.col("_row") + F.coalesce("_start", F.lit(0))
    return rows.select(table.alias("table_id"), place.alias("row_ord"), *columns)


def named_table(df, table_id, row_ord):
    """Give an in-memory or single-table frame the scan columns. ``row_ord``: dense 0-based key."""
    return df.withColumn("table_id", F.lit(table_id)).withColumn(
        "row_ord", row_ord.cast("bigint")
    )


def chunk_size(min_rows=2, max_rows=None, query_range=None, explicit=None):
    """Rows per chunk: as given, else the largest of the row minimum, row cap and query need."""
    if explicit is not None:
        if int(explicit) <= 0:
            raise ValueError("rows per chunk must be positive")
        return int(explicit)
    needs = [int(min_rows)]
    if max_rows is not None:
        needs.append(int(max_rows))
    if query_range is not None:
        needs.append(max(int(q) for q in query_range) + 1)
    return max(needs)


def cut_chunks(rows, size, min_rows=1):
    """Number the chunks of each table and drop those with fewer than min_rows rows.

    Only the last chunk of a table can be short, so one short (table, chunk) pair per table is
    found from the row counts and removed; nothing else moves.
    """
    cut = rows.withColumn("chunk_id", F.floor(F.col("row_ord") / size).cast("bigint"))
    if min_rows <= 1:
        return cut
    if min_rows > size:
        return cut.where(F.lit(False))
    counts = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("_n"))
    tail = F.col("_n") % size
    short = counts.where((tail > 0) & (tail < min_rows)).select(
        "table_id", F.floor(F.col("_n") / size).cast("bigint").alias("chunk_id")
    )
    return cut.join(short, ["table_id", "chunk_id"], "left_anti")


def probe_chunk(chunked):
    """First kept chunk of each table. Chunks before the tail are full, so it is chunk 0."""
    return chunked.where(F.col("chunk_id") == 0)


def features_of(df, exclude=()):
    skip = set(exclude) | {*ROW_COLUMNS, "is_query"}
    return [f for f in df.schema.fields if f.name not in skip]


def to_cells(rows, times=(), exclude=()):
    """Long form of a chunked table: one row per cell with its channel value.

    (table_id, chunk_id, row_ord, col, col_ord, kind, num, txt, ts); nulls stay null. A narrow
    generate step, no shuffle.
    """
    fields = features_of(rows, exclude)
    kind = kinds(T.StructType(fields), times)
    cells = ", ".join(_cell_sql(i, f, kind[f.name]) for i, f in enumerate(fields))
    ids = [c for c in ROW_COLUMNS if c in rows.columns]
    return rows.selectExpr(*ids, f"inline(array({cells}))")


def _cell_sql(ordinal, field, kind):
    value = channel_sql(field.name, field.dataType, kind)
    name = field.name.replace("\\", "\\\\").replace("'", "\\'")
    num = value if kind in (NUM, TIME) else "cast(null as double)"
    txt = value if kind == TEXT else "cast(null as string)"
    ts = value if kind == DATE else "cast(null as timestamp_ntz)"
    return (
        f"named_struct('col', '{name}', 'col_ord', {ordinal}, 'kind', '{kind}', "
        f"'num', {num}, 'txt', {txt}, 'ts', {ts})"
    )


def open_path(path):
    """Filesystem and path for a location string; bare paths are local.

    A scheme Arrow does not know is an error, never an unreadable file.
    """
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    uri = f"s3://{rest}" if scheme in ("s3a", "s3n") else path
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as exc:
        raise RuntimeError(f"no filesystem for {path}") from exc


def schema_text(schema):
    """A footer's Arrow schema as text, without its metadata."""
    return base64.b64encode(schema.remove_metadata().serialize().to_pybytes()).decode()


def schema_groups(spark, root, tables=None):
    """Split a corpus by schema: ([(schema, [paths], bytes)], [unreadable paths]).

    Paths and distinct schemas are what Spark's driver has to know to plan any scan; no rows are
    read. One scan per schema replaces one plan per file.
    """
    from .corpus import plan_corpus

    return _schema_groups(plan_corpus(spark, root, tables))


def _schema_groups(plan):
    spark = plan.splits.sparkSession
    files = plan.splits.groupBy("path").agg(F.any_value("schema_key").alias("key"), F.sum("bytes").alias("n"))
    groups, unreadable = {}, []
    for path, key, size in files.collect():
        if key is None:
            unreadable.append(path)
        else:
            groups.setdefault(key, []).append((path, size))
    schemas = dict(plan.schemas())
    ordered = sorted(groups.items(), key=lambda g: min(g[1]))
    listed = [(schemas[k], sorted(p for p, _ in g), sum(n for _, n in g)) for k, g in ordered]
    return listed, sorted(unreadable)


def _spark_schema(spark, key, path):
    """Spark schema of a serialised footer schema; types Arrow and Spark do not share are left to
    Spark's own reader."""
    arrow = pa.ipc.read_schema(pa.py_buffer(base64.b64decode(key)))
    try:
        return from_arrow_schema(arrow, prefer_timestamp_ntz=True)
    except PySparkTypeError:
        return spark.read.parquet(path).schema


def probe_cells(spark, root, tables, size, min_rows=1, times=()):
    """Cells of the probe chunk of every table of a corpus; see ``corpus`` for how files are read."""
    from . import corpus

    return corpus.probe_cells(corpus.plan_corpus(spark, root, tables), size, min_rows, times)


def corpus_tables(spark, root, tables=None):
    """One scanned frame per schema of the corpus."""
    from .corpus import plan_corpus

    plan = plan_corpus(spark, root, tables)
    groups, _ = _schema_groups(plan)
    starts = plan.readable().groupBy("path").agg(F.min("first_row").alias("start")).where("start > 0")
    starts = None if starts.isEmpty() else starts
    return [spread(scan(spark, root, p, schema, starts), len(p), size) for schema, p, size in groups]


def spread(rows, n_files, n_bytes, worth=4 << 20):
    """Spread a table of very few files over the cores. A row group is read by one task, so a
    single small file would keep all later steps of its stage on one core. Larger inputs have
    splits enough and are left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    limit = 128 << 20
    if n_bytes < worth or n_files >= cores or n_bytes > limit * cores:
        return rows
    return rows.repartition(cores, "row_ord")


def union_all(frames):
    """Union by name, halving: the plan's depth grows with the logarithm of the frame count."""
    frames = list(frames)
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]


def corpus_cells(frames, size, min_rows=1, probe=False, times=()):
    """Cells of all tables of a corpus as one relation, chunked; optionally probe chunks only."""
    parts = []
    for frame in frames:
        cut = cut_chunks(frame, size, min_rows)
        parts.append(to_cells(probe_chunk(cut) if probe else cut, times))
    return union_all(parts)
