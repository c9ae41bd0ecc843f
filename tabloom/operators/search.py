"""Exact best similarity to each class of each bag, with pivot bounds in place of a full product.

The vectors of one class in one bag are cut into blocks of near ones. A block has a pivot, the angle
within which its vectors lie around it, and the range of their norms. By the triangle inequality of
angles no vector of the block is nearer to a query than the query's angle to the pivot less that angle, so
a block whose bound does not exceed the best found so far is left out before its matrix product.

Blocks are written to the shared folder. Tasks stream queries and take up one bag's blocks at a time,
the last ones used being held up to ``HELD_BYTES``: the same way for any number of context rows, nothing is
broadcast, and queries never shuffle.

Defined cases: a query without a vector has no similarities; context rows without a vector or code do
not count; a class a bag lacks has a null there; vectors of no length have cosine 0 and are never left out.
"""

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import functions as F

from ..functions.vectors import NORM_FLOOR
from ..sources.scan import open_path
from ..sources.shared import fresh_path

BLOCK = 256
QUERY_ROWS = 1024
HELD_BYTES = 256 << 20
OUT_BYTES = 16 << 20  # similarities a task holds before it gives them out
SLACK = 1e-9  # of a bound, against rounding
BLOCKS = "bag int, code int, pivot array<double>, angle double, low double, high double, vectors array<double>"


def units(m):
    return m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), NORM_FLOOR))


def cut_blocks(vectors, most=BLOCK):
    """Row numbers of blocks of near vectors: halves along the line between two far ones, until small."""
    unit, out, waiting = units(vectors), [], [np.arange(len(vectors))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = unit[rows]
        one = own[np.argmin(own @ own.mean(axis=0))]
        other = own[np.argmin(own @ one)]
        order = np.argsort(own @ (one - other), kind="stable")
        half = len(rows) // 2
        waiting += [rows[order[:half]], rows[order[half:]]]
    return out


def bounds_of(vectors):
    """(pivot, angle, least norm, greatest norm) of a block."""
    unit, norm = units(vectors), np.sqrt((vectors * vectors).sum(axis=1))
    pivot = units(unit.mean(axis=0)[None])[0]
    sure = (np.abs((unit * unit).sum(axis=1) - 1) < 1e-9).all() and abs(pivot @ pivot - 1) < 1e-9
    angle = float(np.arccos(np.clip(unit @ pivot, -1, 1)).max()) if sure else np.pi
    return pivot, angle, float(norm.min()), float(norm.max())


def best_by_class(queries, blocks, n_codes, kind):
    """(best, products): the greatest cosine or dot product to each class, NaN for none, and how many pairs
    were multiplied. ``blocks``: (code, pivot, angle, low, high, vectors) of one bag."""
    best, products = np.full((len(queries), n_codes), -np.inf), 0
    unit, norm = units(queries), np.sqrt((queries * queries).sum(axis=1))
    if not blocks or not len(queries):
        return np.where(np.isinf(best), np.nan, best), products
    pivots = np.stack([b[1] for b in blocks])
    angle, low, high = (np.array([b[i] for b in blocks]) for i in (2, 3, 4))
    apart = np.arccos(np.clip(unit @ pivots.T, -1, 1)) - angle
    bound = np.cos(np.maximum(apart, 0))
    if kind == "dot":
        bound = norm[:, None] * np.where(bound > 0, high, low) * bound
    bound = bound + SLACK * (1 + np.abs(bound))
    bound[norm * norm <= NORM_FLOOR] = np.inf
    side = unit if kind == "cosine" else queries
    for b in np.argsort(-bound.mean(axis=0), kind="stable"):
        code, vectors = blocks[b][0], blocks[b][5]
        rows = np.flatnonzero(bound[:, b] > best[:, code])
        if len(rows):
            found = side[rows] @ (units(vectors) if kind == "cosine" else vectors).T
            best[rows, code] = np.maximum(best[rows, code], found.max(axis=1))
            products += found.size
    return np.where(np.isneginf(best), np.nan, best), products


def write_blocks(context, code, vec, most=BLOCK):
    """Blocks of (bag, code) below the shared folder, in files by bag; gives their path."""
    spark = context.sparkSession
    rows = context.select(F.col("bag").cast("int").alias("bag"), F.col(code).cast("int").alias("code"), F.col(vec).cast("array<double>").alias("v"))
    # Rows repeated by sampling with replacement add nothing to a maximum.
    rows = rows.where("code is not null and v is not null").dropDuplicates(["bag", "code", "v"])

    def cut(group):
        vectors = _matrix(group.column("v").combine_chunks())
        out = []
        for part in cut_blocks(vectors, most):
            pivot, angle, low, high = bounds_of(vectors[part])
            out.append({"pivot": pivot, "angle": angle, "low": low, "high": high, "vectors": vectors[part].ravel()})
        table = pa.Table.from_pylist(out, pa.schema([("pivot", pa.list_(pa.float64())), ("angle", pa.float64()), ("low", pa.float64()),
                                                    ("high", pa.float64()), ("vectors", pa.list_(pa.float64()))]))
        for i, name in enumerate(("bag", "code")):
            table = table.add_column(i, name, pa.array([group.column(name)[0].as_py()] * len(out), pa.int32()))
        return table

    path = fresh_path(spark, "blocks")
    rows.groupBy("bag", "code").applyInArrow(cut, BLOCKS).write.partitionBy("bag").parquet(path)
    return path


def _matrix(column):
    """Arrow list column of vectors of one length, without nulls, as a matrix."""
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Blocks:
    """Blocks of bags, read when asked for; the last ones used are held up to a number of bytes."""

    def __init__(self, path, held_bytes):
        fs, inner = open_path(path)
        bag = pads.partitioning(pa.schema([("bag", pa.int32())]), flavor="hive")
        self.all = pads.dataset(inner, filesystem=fs, format="parquet", partitioning=bag)
        self.most, self.held, self.size = held_bytes, OrderedDict(), 0

    def of(self, bag):
        if bag in self.held:
            self.held.move_to_end(bag)
            return self.held[bag][0]
        table = self.all.to_table(filter=pads.field("bag") == bag)
        blocks = []
        for r in range(len(table)):
            pivot = table["pivot"][r].values.to_numpy()
            vectors = table["vectors"][r].values.to_numpy().reshape(-1, len(pivot))
            blocks.append((table["code"][r].as_py(), pivot, *(table[c][r].as_py() for c in ("angle", "low", "high")), vectors))
        size = table.nbytes
        while self.held and self.size + size > self.most:
            self.size -= self.held.popitem(last=False)[1][1]
        self.held[bag] = blocks, size
        self.size += size
        return blocks


def bag_scores(queries, context, row, vec, code, n_codes, bags, kind="cosine", most=BLOCK, held_bytes=HELD_BYTES):
    """(row, sims): best similarity of every query row to each class code in each bag.

    ``sims`` is an array at position bag · n_codes + code, null where the bag lacks the class, and null
    itself without a query vector. ``context`` has bag (0..bags-1), the code (0..n_codes-1) and the vector.
    """
    if kind not in ("cosine", "dot"):
        raise ValueError("kind is cosine or dot")
    path = write_blocks(context, code, vec, most)
    qry = queries.select(row, F.col(vec).cast("array<double>").alias("_v"))
    row_type = qry.schema[row].dataType.simpleString()

    def stream(batches):
        blocks = Blocks(path, held_bytes)
        most = max(1, OUT_BYTES // max(1, 8 * bags * n_codes))
        for batch in (b.slice(at, most) for b in batches for at in range(0, len(b), most)):
            vectors = batch.column(1)
            given = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            q = _matrix(vectors.take(pa.array(given)))
            out = np.full((len(given), bags, n_codes), np.nan)
            for bag in range(bags):
                own = blocks.of(bag)
                for at in range(0, len(q), QUERY_ROWS):
                    out[at : at + QUERY_ROWS, bag] = best_by_class(q[at : at + QUERY_ROWS], own, n_codes, kind)[0]
            if kind == "dot":
                out = 1.0 / (1.0 + np.exp(-out))
            full = np.zeros(len(batch), dtype=np.int64)
            full[given] = bags * n_codes
            ends = pa.array(np.concatenate(([0], np.cumsum(full))).astype(np.int32))
            sims = pa.ListArray.from_arrays(ends, pa.array(out.ravel(), from_pandas=True), mask=vectors.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), sims], names=[row, "sims"])

    return qry.mapInArrow(stream, f"`{row}` {row_type}, sims array<double>")
