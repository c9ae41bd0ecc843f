"""A corpus of Parquet tables as one planned source: splits from the footers, rows in Arrow.

``plan_corpus`` reads every footer once, in tasks, and writes one short row per split: a file's run of
row groups of bounded bytes, with its schema, first row and the table's row count. The rows of a table of
several files go on from part to part, in path order; a part whose footer cannot be read counts as empty. Everything that
used to need a pass over the files comes from it: schemas, row counts, probe splits, short
tails, and which files a target belongs to.

``read_rows`` hands chosen splits of one schema to a Python data source. Small splits share a task, large
files are cut between row groups, only the wanted columns are decoded, chunks are numbered and short
tails left out at the source.

One rule for errors, for probes and scans alike: an input error is tried again; if it stays and the
bytes can be fetched, what is wrong is in the file, so the rest of that row group is left out and
reported; if they cannot, the store is away and the job fails. Reports are written by the scan itself, one
small file for each broken row group under a name of its own, so repeated tasks report once.
"""

import hashlib
import json
import time
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .manifest import list_tables
from .scan import ROW_COLUMNS, _spark_schema, open_path, schema_text, to_cells, union_all
from .shared import fresh_path

NAME = "tabloom_corpus"
SPLIT_BYTES = 128 << 20
BATCH_ROWS = 8_192
ATTEMPTS, WAIT = 3, 0.2
SPLIT = (
    "table_id string, path string, schema_key string, first int, end int, first_row long, n_rows long, "
    "table_rows long, bytes long, reason string"
)
REPORT = "table_id string, path string, row_group int, first_row long, reason string"


def fetch(path, start=0, length=None, block=8 << 20):
    """Read bytes of a file and drop them; an error means that the store does not give them."""
    fs, inner = open_path(path)
    with fs.open_input_file(inner) as f:
        end = f.size() if length is None else min(f.size(), start + length)
        f.seek(start)
        while f.tell() < end and f.read(min(block, end - f.tell())):
            pass


def attempt(path, read, span=(0, None), attempts=ATTEMPTS, wait=WAIT):
    """(what read() gives, None), or (None, reason) if the file is broken; raises if the store is away."""
    for n in range(attempts):
        try:
            return read(), None
        except pa.ArrowException as error:  # what was read is no Parquet
            return None, _reason(error)
        except OSError as error:
            failed = error
            if n < attempts - 1:
                time.sleep(wait * 2**n)
    fetch(path, *span)
    return None, _reason(failed)


def _reason(error):
    return f"{type(error).__name__}: {error}".splitlines()[0][:300]


def opened(path):
    fs, inner = open_path(path)
    return pq.ParquetFile(fs.open_input_file(inner))


def _file_splits(table_id, path, split_bytes):
    meta, reason = attempt(path, lambda: opened(path).metadata)
    if reason is None:
        key, reason = attempt(path, lambda: schema_text(meta.schema.to_arrow_schema()))
    if reason is not None:
        return [(table_id, path, None, None, None, None, None, None, None, reason)]
    out, first, row, rows, size = [], 0, 0, 0, 0
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        if rows and size + group.total_byte_size > split_bytes:
            out.append((table_id, path, key, first, g, row, rows, meta.num_rows, size, None))
            first, row, rows, size = g, row + rows, 0, 0
        rows, size = rows + group.num_rows, size + group.total_byte_size
    return [*out, (table_id, path, key, first, meta.num_row_groups, row, rows, meta.num_rows, size, None)]


@dataclass(frozen=True)
class CorpusPlan:
    """Splits of a corpus, written to ``path``; ``report`` is the folder where scans report what they left
    out."""

    splits: DataFrame
    path: str
    report: str

    def readable(self):
        return self.splits.where("reason is null")

    def schemas(self):
        """[(schema_key, Spark schema)] in the order of their first path: what any scan has to know."""
        firsts = self.readable().groupBy("schema_key").agg(F.min("path").alias("path")).collect()
        spark = self.splits.sparkSession
        return [(r.schema_key, _spark_schema(spark, r.schema_key, r.path)) for r in sorted(firsts, key=lambda r: r.path)]

    def table_rows(self):
        """(table_id, n_rows) from the footers; 0 where the footer cannot be read."""
        return self.splits.groupBy("table_id").agg(F.coalesce(F.max("table_rows"), F.lit(0)).alias("n_rows"))

    def chunks(self, size, min_rows=1):
        """(table_id, chunk_id) of every chunk with enough rows, from the footers."""
        whole = F.expr(f"n_rows div {size} + if(n_rows % {size} >= {max(1, min_rows)}, 1, 0)")
        last = F.when(F.lit(min_rows <= size), whole).otherwise(0)
        counted = self.table_rows().select("table_id", last.cast("long").alias("_k")).where("_k > 0")
        return counted.select("table_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("chunk_id"))

    def skipped(self):
        """(table_id, path, row_group, first_row, reason): unreadable files, and what the scans run so far
        left out."""
        spark = self.splits.sparkSession
        files = self.splits.where("reason is not null")
        none = F.lit(None)
        files = files.select("table_id", "path", none.cast("int").alias("row_group"), none.cast("long").alias("first_row"), "reason")
        return files.union(spark.read.schema(REPORT).option("pathGlobFilter", "*.json").json(self.report))


def plan_corpus(spark, root, tables=None, split_bytes=SPLIT_BYTES):
    """The plan of all tables below a root, or of those given as (table_id, path)."""
    tables = list_tables(spark, root) if tables is None else tables

    def cut(batches):
        names = [f.split()[0] for f in SPLIT.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in SPLIT.split(", ")]
        for batch in batches:
            for table_id, path in zip(*(c.to_pylist() for c in batch.columns)):
                found = _file_splits(table_id, path, split_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found), types)], names)

    report = fresh_path(spark, "skipped")
    _mkdir(report)
    path = fresh_path(spark, "corpus-plan")
    _placed(tables.select("table_id", "path").mapInArrow(cut, SPLIT)).write.parquet(path)
    return CorpusPlan(spark.read.schema(SPLIT).parquet(path), path, report)


def _placed(splits):
    """Splits with their first row and row count in the table, which may have several files."""
    table = W.partitionBy("table_id")
    before = F.sum("n_rows").over(table.orderBy("path", "first").rowsBetween(W.unboundedPreceding, -1))
    places = {"first_row": F.coalesce(before, F.lit(0)), "table_rows": F.sum("n_rows").over(table)}
    return splits.withColumns({c: F.when(F.col("reason").isNull(), x) for c, x in places.items()})


def _mkdir(uri):
    fs, inner = open_path(uri)
    fs.create_dir(inner, recursive=True)


class CorpusSource(DataSource):
    """Rows of splits of one schema: table_id, chunk_id, row_ord and the wanted columns."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return T.StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema):
        return CorpusReader(self.options, schema)


class Part(InputPartition):
    """Splits that one task reads."""

    def __init__(self, splits):
        self.splits = splits


class CorpusReader(DataSourceReader):
    def __init__(self, options, schema):
        self.at, self.where, self.report = options["splits"], json.loads(options["where"]), options["report"]
        self.size, self.min_rows = int(options["size"]), int(options["minrows"])
        self.probe, self.most = options["probe"] == "true", int(options["bytes"])
        self.arrow = to_arrow_schema(schema)

    def partitions(self):
        fs, inner = open_path(self.at)
        own = pads.field("reason").is_null()
        for column, value in self.where.items():
            own = own & (pads.field(column) == value)
        columns = ["table_id", "path", "first", "end", "first_row", "n_rows", "table_rows", "bytes"]
        splits = pads.dataset(inner, filesystem=fs, format="parquet").to_table(columns, filter=own).to_pylist()
        splits.sort(key=lambda s: (s["path"], s["first"]))
        parts, size = [], 0
        for s in splits:
            if self.probe:
                if s["first_row"] >= self.size:
                    continue
                s["bytes"] = s["bytes"] * min(1.0, self.size / max(1, s["n_rows"]))
            cost = s["bytes"] + (4 << 20)  # opening a file counts as some megabytes
            if not parts or size + cost > self.most:
                parts.append([])
                size = 0
            parts[-1].append(s)
            size += cost
        return [Part(p) for p in parts or [[]]]

    def read(self, partition):
        for split in partition.splits:
            yield from self._split(split)

    def _end(self, split):
        """First row that is in no chunk: a short tail, or what lies behind the probe."""
        rows = split["table_rows"]
        tail = rows % self.size
        end = rows - tail if tail < self.min_rows else rows
        if self.min_rows > self.size:
            end = 0
        return min(end, self.size) if self.probe else end

    def _split(self, split):
        end, row = self._end(split), split["first_row"]
        if row >= end:
            return
        table, reason = attempt(split["path"], lambda: opened(split["path"]))
        if reason is not None:
            return self._skip(split, split["first"], row, reason)
        for g in range(split["first"], split["end"]):
            if row >= end:
                return
            group = table.metadata.row_group(g)
            yield from self._group(split, table, g, row, end)
            row += group.num_rows

    def _group(self, split, table, g, first_row, end):
        """Batches of a row group up to a row; reading goes on behind what was given out already."""
        wanted = [c for c in self.arrow.names if c not in ROW_COLUMNS]
        meta = table.metadata.row_group(g)
        starts = [meta.column(c).dictionary_page_offset or meta.column(c).data_page_offset for c in range(meta.num_columns)]
        span = (min(starts, default=0), sum(meta.column(c).total_compressed_size for c in range(meta.num_columns)))
        given, row, batches = 0, first_row, None

        def following():
            nonlocal batches
            try:
                if batches is None:
                    batches = opened(split["path"]).iter_batches(BATCH_ROWS, row_groups=[g], columns=wanted)
                    for _ in range(given):
                        next(batches, None)
                return next(batches, None)
            except Exception:
                batches = None
                raise

        while row < end:
            batch, reason = attempt(split["path"], following, span)
            if reason is None and batch is not None:
                cast, reason = attempt(split["path"], lambda batch=batch, row=row: self._shaped(split, batch, row, end))
            if reason is not None:
                self._skip(split, g, row, reason)
                return
            if batch is None:
                return
            yield cast
            given, row = given + 1, row + batch.num_rows

    def _shaped(self, split, batch, row, end):
        n = min(batch.num_rows, end - row)
        batch = batch.slice(0, n)
        place = pa.array(range(row, row + n), pa.int64())
        keys = {"table_id": pa.array([split["table_id"]] * n, pa.string()), "row_ord": place}
        keys["chunk_id"] = pa.array([r // self.size for r in range(row, row + n)], pa.int64())
        columns = [
            keys[f.name] if f.name in keys else pa.chunked_array([batch.column(batch.schema.get_field_index(f.name))]).cast(f.type).combine_chunks()
            for f in self.arrow
        ]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)

    def _skip(self, split, g, row, reason):
        name = hashlib.md5(f"{split['path']}:{g}".encode()).hexdigest()
        fs, inner = open_path(f"{self.report}/{name}.json")
        found = {"table_id": split["table_id"], "path": split["path"], "row_group": g, "first_row": row, "reason": reason}
        with fs.open_output_stream(inner) as f:
            f.write(json.dumps(found).encode() + b"\n")


def read_rows(plan, where, schema, size, min_rows=1, columns=None, probe=False, task_bytes=SPLIT_BYTES, at=None):
    """Rows of splits of one schema, in chunks of ``size`` rows: (table_id, chunk_id, row_ord, columns).

    The splits are those of the plan, or of the written table of splits ``at``, whose columns have the
    values of ``where``. ``probe`` stops after the first chunk of each table. ``columns`` are those to decode.
    """
    spark = plan.splits.sparkSession
    spark.dataSource.register(CorpusSource)
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    fields = [T.StructField("table_id", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("row_ord", T.LongType())]
    shape = T.StructType(fields + [T.StructField(f.name, f.dataType) for f in wanted])
    options = {
        "splits": at or plan.path, "where": json.dumps(where), "schema": shape.json(), "report": plan.report, "size": str(size), "minrows": str(min_rows),
        "probe": str(probe).lower(), "bytes": str(task_bytes),
    }
    return spark.read.format(NAME).options(**options).load()


def probe_cells(plan, size, min_rows=1, times=()):
    """Cells of the probe chunk of every table of a plan."""
    parts = []
    for key, schema in plan.schemas():
        rows = read_rows(plan, {"schema_key": key}, schema, size, min_rows, probe=True)
        parts.append(to_cells(rows, times))
    if not parts:
        raise ValueError("no readable table")
    return union_all(parts)
