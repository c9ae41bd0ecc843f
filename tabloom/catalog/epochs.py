"""Queries on epochs written by stage and shard."""

from pyspark.sql import functions as F

from ..plans.corpus import Encoding
from ..plans.epochs import Stage, read_epochs, write_epochs
from ..plans.prepare import SampleConfig
from ..sources.shared import fresh_path
from .registry import SEED, TABLES, query, sql_chunked, sql_draw
from .samples import EDGE_SCALE, RANGE, sql_bins

STAGES = {"labels": (1000, 2), "values": (500, 2)}  # rows per chunk, epochs


def _split(size, seed):
    """Events split by the draws of one epoch; corpus samples have a replica in their key."""
    order = sql_draw("row_order", "table_id", "chunk_id", "0", "row_ord", seed=seed)
    pick = sql_draw("query_rows", "table_id", "chunk_id", "0", seed=seed)
    top = f"least({RANGE[1]}, n - 1)"
    low = f"greatest(1, least({RANGE[0]}, {top}))"
    return f"""select *, pos > n - ({low} + {pick} % (greatest({top}, {low}) - {low} + 1)) as is_query from (
        select *, row_number() over (partition by chunk_id order by {order}, row_ord) as pos,
          count(*) over (partition by chunk_id) as n from ({sql_chunked("events", "event_id", size)})) where n >= 150"""


def _label_codes(source, seed):
    counts = f"select chunk_id, event_type as label, count(*) as n from ({source}) where not is_query and event_type is not null group by 1, 2"
    top = f"select *, row_number() over (partition by chunk_id order by n desc, label) as r from ({counts})"
    draw = sql_draw("label", "'events'", "chunk_id", "0", "label", seed=seed)
    codes = f"select chunk_id, label, row_number() over (partition by chunk_id order by {draw}, label) - 1 as code from ({top}) where r <= 62"
    return f"""select s.*, coalesce(m.code, 62) as code from ({source}) s left join ({codes}) m
        on s.chunk_id = m.chunk_id and s.event_type = m.label"""


def _epochs_check():
    parts = []
    for name, (size, epochs) in STAGES.items():
        for epoch in range(epochs):
            split = _split(size, SEED + epoch)
            coded = _label_codes(split, SEED + epoch) if name == "labels" else sql_bins(split, "value")
            code, task = ("code", "classification") if name == "labels" else ("floor_code", "regression")
            parts.append(
                f"""select chunk_id, '{task}' as task, '{name}' as stage, {epoch} as epoch, is_query, {code} as code, row_ord from ({coded})"""
            )
    return f"""select stage, epoch::bigint as epoch, task, chunk_id, count(*) as n_rows, count(*) filter (is_query) as n_query,
        sum(code) filter (not is_query)::double as target_sum, sum(row_ord) filter (is_query)::bigint as query_rows
        from ({' union all '.join(parts)}) group by 1, 2, 3, 4"""


@query("epoch_samples", _epochs_check)
def epoch_samples(spark, d):
    """Two stages of two epochs of the shard that holds events, written, repeated and read back."""
    common = dict(query_range=RANGE, shuffle=True, min_rows=150, auto_target=False, seed=SEED)
    stages = []
    for name, (size, epochs) in STAGES.items():
        labels = name == "labels"
        config = SampleConfig(
            **common, max_rows=size, rows_per_chunk=size, target="event_type" if labels else "value",
            keyword="regression" if labels else "events",
        )
        stages.append(Stage(name, config, epochs, Encoding(scale=EDGE_SCALE)))
    path = fresh_path(spark, "epochs")
    shard = (TABLES.index("events"), len(TABLES))  # tables are dealt by their place among the names
    write_epochs(spark, d, path, stages[:1], shard)
    write_epochs(spark, d, path, stages, shard)
    rows = read_epochs(spark, path).where("col_pos = 0")
    target = F.coalesce(F.col("target_int").cast("double"), F.col("target_float").cast("double"))
    return rows.groupBy("stage", F.col("epoch").cast("bigint").alias("epoch"), "task", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_query").alias("n_query"),
        F.sum(F.when(~F.col("is_query"), target)).alias("target_sum"),
        F.sum(F.when(F.col("is_query"), F.col("row_ord"))).alias("query_rows"),
    )
