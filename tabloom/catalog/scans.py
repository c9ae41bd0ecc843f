"""Queries on sources, scans, columns and target planning."""

from pyspark.sql import functions as F

from ..functions.draws import draw
from ..operators import columns as C
from ..operators import encode as E
from ..operators import profile as P
from ..operators import sampling as S
from ..operators import targets as T
from ..plans.corpus import corpus_samples
from ..plans.prepare import SampleConfig
from ..sources import guards, manifest, scan, sink
from ..sources.corpus import plan_corpus, probe_cells
from ..sources.shared import fresh_path, stage
from .registry import (
    SEED,
    TABLES,
    big,
    chunked,
    columns_of,
    query,
    rounded,
    sql_cells,
    sql_chunked,
    sql_draw,
    sql_numbered,
    sql_profile,
    sql_split,
    table,
)

B = 1000  # rows per chunk and per probe


def corpus(spark, sf_dir):
    """The given tables as a corpus: one frame per schema."""
    return scan.corpus_tables(spark, sf_dir)


def probe_profile(spark, sf_dir):
    return P.profile(scan.probe_cells(spark, sf_dir, None, B))


COUNTS = " union all ".join(f"select '{t}' as table_id, count(*) as n_rows from {t}" for t in TABLES)
MANIFEST = f"select table_id, row_number() over (order by table_id) - 1 as ord, n_rows from ({COUNTS})"


@query("table_manifest", MANIFEST)
def table_manifest(spark, d):
    return manifest.manifest(spark, d).select("table_id", "ord", "n_rows")


@query("shard_tables", f"select table_id, ord from ({MANIFEST}) where ord % 4 = 1")
def shard_tables(spark, d):
    return manifest.shard(manifest.manifest(spark, d), 1, 4).select("table_id", "ord")


@query(
    "chunk_scan",
    f"""select table_id, row_ord // 1000 as chunk_id, count(*) as n_rows,
        min(row_ord) as first_row, max(row_ord) as last_row
        from ({sql_numbered()}) group by 1, 2 having count(*) >= 300""",
)
def chunk_scan(spark, d):
    parts = [
        scan.cut_chunks(f, B, 300).select("table_id", "chunk_id", "row_ord") for f in corpus(spark, d)
    ]
    return (
        scan.union_all(parts)
        .groupBy("table_id", "chunk_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("row_ord").alias("first_row"),
            F.max("row_ord").alias("last_row"),
        )
    )


@query(
    "probe_chunk",
    f"""select table_id, count(*) as n_rows, max(row_ord) as last_row
        from ({sql_numbered()}) where row_ord < 1000 group by 1 having count(*) >= 100""",
)
def probe_chunk(spark, d):
    cells = scan.probe_cells(spark, d, None, B, 100).where("col_ord = 0")
    return cells.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("row_ord").alias("last_row")
    )


@query(
    "corpus_cells",
    f"""select table_id, col, any_value(col_ord)::bigint as col_ord, any_value(kind) as kind,
        count(*) as n_cells, count(v) as n_present, round(sum(num), 2) as num_sum,
        sum(length(txt))::bigint as txt_chars, min(ts) as ts_min, max(ts) as ts_max
        from ({sql_cells()}) group by 1, 2""",
)
def corpus_cells(spark, d):
    cells = scan.corpus_cells(corpus(spark, d), B)
    nested = F.col("col") == "embedding"  # arrays print differently on the two engines
    return cells.groupBy("table_id", "col").agg(
        F.any_value("col_ord").cast("bigint").alias("col_ord"),
        F.any_value("kind").alias("kind"),
        F.count(F.lit(1)).alias("n_cells"),
        F.count(P.value_key()).alias("n_present"),
        F.round(F.sum("num"), 2).alias("num_sum"),
        F.sum(F.when(~nested, F.char_length("txt"))).cast("bigint").alias("txt_chars"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
    )


def _sink_check():
    parts = []
    for epoch in (0, 1):
        src = sql_chunked("events", "event_id", B)
        split = sql_split(src).replace("'42'", f"'{42 + epoch}'")
        for task in ("classification", "regression"):
            typed = "int" if task == "classification" else "float"
            parts.append(
                f"select '{task}' as task, 'stage1' as stage, {epoch} as epoch, count(*) as n_rows,"
                f" count(*) filter (is_query) as n_query, '{typed}' as typed from ({split})"
            )
    return f"select task, stage, epoch::bigint as epoch, n_rows, n_query, typed from ({' union all '.join(parts)})"


@query("sample_sink", _sink_check)
def sample_sink(spark, d):
    base = S.deal_samples(chunked(spark, d, "events", "event_id", B))
    parts = []
    for epoch in (0, 1):
        ordered = S.order_rows(base, SEED + epoch, shuffle=True)
        split = S.split_context(ordered, SEED + epoch, query_range=(50, 900))
        for task, column in (("classification", "event_type"), ("regression", "value")):
            coded = E.encode_target(split, column, task, seed=SEED + epoch)
            parts.append(
                coded.select(
                    "table_id", "chunk_id", "row_ord", "is_query", "target", "target_delta",
                    F.lit(task).alias("task"), F.lit("stage1").alias("stage"),
                    F.lit(epoch).alias("epoch"),
                )
            )
    written = sink.write_samples(scan.union_all(parts), fresh_path(spark, "samples"))
    return written.groupBy("task", "stage", big("epoch")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_query").alias("n_query"),
        F.when(F.count("target_int") > 0, "int").otherwise("float").alias("typed"),
    )


STAGES = (("stage1", 1000, 2), ("stage2", 4000, 3))


@query(
    "epoch_plan",
    f"""select table_id, stage, epoch, epoch_seed, rows_per_sample::bigint as rows_per_sample,
        {sql_draw("sample", "table_id", seed="epoch_seed::varchar")} as first_draw from (
        select table_id, 'stage1' as stage, 1000 as rows_per_sample, e as epoch, e + 42 as epoch_seed
          from ({COUNTS}), range(2) r(e) union all
        select table_id, 'stage2', 4000, e, e + 42 from ({COUNTS}), range(3) r(e))""",
)
def epoch_plan(spark, d):
    tables = manifest.table_rows(spark, d)
    plan = manifest.epoch_plan([(n, tables, rows, e) for n, rows, e in STAGES], SEED)
    return plan.select(
        "table_id", "stage", big("epoch"), "epoch_seed", "rows_per_sample",
        draw(F.col("epoch_seed"), "sample", "table_id").alias("first_draw"),
    )


@query(
    "invalid_text_filter",
    """select event_id // 100 as chunk_id, count(*) as n_rows from events
       where event_id // 100 not in (select event_id // 100 from events where event_id % 977 = 5)
       group by 1""",
)
def invalid_text_filter(spark, d):
    rows = chunked(spark, d, "events", "event_id", 100)
    broken = F.unhex(F.lit("C328")).cast("string")
    spoiled = rows.withColumn(
        "props", F.when(F.col("event_id") % 977 == 5, broken).otherwise(F.col("props"))
    )
    return guards.drop_invalid_text(spoiled).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- columns and filters ------------------------------------------------------------------


@query(
    "feature_target_split",
    """select o_orderkey, concat_ws('|', o_custkey::varchar, o_orderstatus, o_orderpriority) as x,
       o_totalprice as y from orders""",
)
def feature_target_split(spark, d):
    x, y = T.split_xy(table(spark, d, "orders"), "o_totalprice", keep=["o_orderkey"])
    features = [F.col(c).cast("string") for c in x.columns if c not in ("o_orderkey", "o_orderdate")]
    left = x.select("o_orderkey", F.concat_ws("|", *features).alias("x"))
    return T.zip_columns(left, y.withColumnRenamed("o_totalprice", "y"), "o_orderkey")


@query(
    "zip_columns",
    "select event_id as row_ord, user_id, event_type, value from events",
)
def zip_columns(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("event_id", "row_ord")
    x, y = T.split_xy(rows.select("row_ord", "user_id", "event_type", "value"), keep=["row_ord"])
    return T.zip_columns(x, y)


@query(
    "few_rows_filter",
    f"select table_id, n_rows from (select table_id, least(n_rows, 1000) as n_rows from ({COUNTS})) where n_rows >= 150",
)
def few_rows_filter(spark, d):
    return P.filter_small(probe_profile(spark, d)).select("table_id", "n_rows").distinct()


WIDTHS = " union all ".join(
    f"select '{t}' as table_id, {len(columns_of(t)) - 1} as n_features from {t}" for t in TABLES
)


@query(
    "feature_limit_filter",
    f"select distinct table_id, n_features::bigint as n_features from ({WIDTHS}) where n_features <= 4",
)
def feature_limit_filter(spark, d):
    kept = P.filter_wide(probe_profile(spark, d), 4)
    return P.table_widths(kept)


@query(
    "long_text_columns",
    f"""select table_id, col, max_chars from ({sql_profile()})
        where kind = 'text' and max_chars > 100 and col <> 'embedding'""",
)
def long_text_columns(spark, d):
    profiled = P.profile(scan.corpus_cells(corpus(spark, d), B))
    # The array column counts as text of its JSON form, which the other engine prints differently.
    named = P.long_text_columns(profiled).where(F.col("col") != "embedding")
    return named.select("table_id", "col", "max_chars")


@query(
    "column_profile",
    f"""select table_id, col, kind, n_rows, n_present, n_distinct, round(null_ratio, 6) as null_ratio,
        round(distinct_ratio, 6) as distinct_ratio, case when col = 'embedding' then null else max_chars end as max_chars
        from ({sql_profile()})""",
)
def column_profile(spark, d):
    profiled = P.profile(scan.corpus_cells(corpus(spark, d), B))
    chars = F.when(F.col("col") != "embedding", F.col("max_chars")).alias("max_chars")
    return profiled.select(
        "table_id", "col", "kind", "n_rows", "n_present", "n_distinct",
        rounded("null_ratio"), rounded("distinct_ratio"), chars,
    )


HOLES = """case when event_id % 7 = 0 then null else value end as gappy,
    cast(null as double) as never, 1 as fixed"""
HOLED = f"select * exclude (v1), case when is_query then value end as late from (select *, 1 as v1 from ({sql_split(sql_chunked('events', 'event_id', B, HOLES))}))"


def holed_events(spark, d):
    """Events, split, with a gappy, an all-null and a constant column, and one null in context."""
    rows = chunked(spark, d, "events", "event_id", B).select(
        "*",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("gappy"),
        F.lit(None).cast("double").alias("never"),
        F.lit(1).alias("fixed"),
    )
    split = S.split_context(S.order_rows(rows, SEED, shuffle=True), SEED, query_range=(50, 900))
    return split.withColumn("late", F.when(F.col("is_query"), F.col("value")))


WATCHED = ("event_type", "gappy", "never", "fixed", "late", "value")


@query(
    "drop_all_null",
    " union all ".join(
        f"select chunk_id, '{c}' as col, count(*) as n_cells, count({c}) as n_present from ({HOLED})"
        f" group by chunk_id having count({c}) filter (not is_query) > 0"
        for c in WATCHED
    ),
)
def drop_all_null(spark, d):
    rows = holed_events(spark, d)
    cells = scan.to_cells(rows.select(*scan.ROW_COLUMNS, *WATCHED))
    marks = rows.select(*scan.ROW_COLUMNS, "is_query")
    cells = cells.join(marks, list(scan.ROW_COLUMNS))
    kept = P.drop_all_null(cells, ("table_id", "chunk_id"), ~F.col("is_query"))
    return kept.groupBy("chunk_id", "col").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(P.value_key()).alias("n_present")
    )


@query(
    "drop_constant",
    " union all ".join(
        f"select chunk_id, '{c}' as col, count(distinct {c}) = 1 as is_constant from ({HOLED}) group by 1"
        for c in WATCHED
    ),
)
def drop_constant(spark, d):
    rows = holed_events(spark, d)
    return C.constant_columns(rows, WATCHED).select("chunk_id", "col", "is_constant")


PART_FEATURES = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "fixed"]
PART_KEPT = f"""select chunk_id, col, src, row_number() over (partition by chunk_id order by src) as nth,
    row_number() over (partition by chunk_id order by {sql_draw("feature", "'part'", "chunk_id", "col")}, src) as pick
    from ({' union all '.join(
        f"select p_partkey // 500 as chunk_id, '{c}' as col, {i} as src, count(distinct {c}) as k "
        f"from (select *, 1 as fixed from part) group by 1" for i, c in enumerate(PART_FEATURES))})
    where k <> 1"""


def part_chunks(spark, d):
    return chunked(spark, d, "part", "p_partkey", 500).select("*", F.lit(1).alias("fixed"), F.lit(0).alias("target"))


@query(
    "sample_features",
    f"select chunk_id, (pick - 1)::bigint as pos, col, true as mask from ({PART_KEPT}) where pick <= 4",
)
def sample_features(spark, d):
    plan = C.column_plan(part_chunks(spark, d), "target", max_columns=5, seed=SEED)
    return plan.select("chunk_id", big("pos"), "col", "mask")


@query(
    "pad_features",
    f"""select chunk_id, (nth - 1)::bigint as pos, col, true as mask from ({PART_KEPT}) union all
        select chunk_id, i, printf('__LOOM_PAD_%02d__', i), false from (
          select chunk_id, max(nth) as k from ({PART_KEPT}) group by 1), range(9) r(i) where i >= k""",
)
def pad_features(spark, d):
    plan = C.column_plan(part_chunks(spark, d), "target", pad=9, seed=SEED)
    return plan.select("chunk_id", big("pos"), "col", C.is_real("col").alias("mask"))


# ---- targets ------------------------------------------------------------------------------

PROBE = f"select *, kind = 'num' as is_num, kind = 'date' as is_date from ({sql_profile(B)})"
LONG = "(kind = 'text' and (max_chars > 100 or col = 'embedding'))"
CANDIDATES = f"""select table_id, col, case when is_num then 'regression' else 'classification' end as task
    from ({PROBE}) where n_present > 0 and not is_date
    and case when is_num then null_ratio <= 0.5 else distinct_ratio <= 0.2 end"""
RULED = f"""select * from ({PROBE}) where n_rows >= 150 and not {LONG} and not is_date
    and distinct_ratio < 0.2 and null_ratio < 0.5"""


@query("target_candidates", CANDIDATES)
def target_candidates(spark, d):
    return P.target_candidates(probe_profile(spark, d)).select("table_id", "col", "task")


@query("rule_candidates", f"select table_id, col, kind from ({RULED})")
def rule_candidates(spark, d):
    kept = P.filter_small(probe_profile(spark, d))
    return P.rule_candidates(kept).select("table_id", "col", "kind")


def _paths(df):
    """A path per table; those of two tables carry the regression keyword."""
    special = F.col("table_id").isin("documents", "part")
    folder = F.when(special, "/data/Regression/").otherwise("/data/plain/")
    return df.withColumn("path", F.concat(folder, F.col("table_id"), F.lit(".parquet")))


SQL_TASK = """case when kind = 'num' or table_id in ('documents', 'part') then 'regression'
    else 'classification' end"""


@query("task_inference", f"select table_id, col, {SQL_TASK} as task from ({RULED})")
def task_inference(spark, d):
    kept = P.rule_candidates(P.filter_small(probe_profile(spark, d)))
    return T.infer_task(_paths(kept)).select("table_id", "col", "task")


CHOSEN = f"""select table_id, col, kind, {SQL_TASK} as task from (
    select *, row_number() over (partition by table_id order by {sql_draw("target", "table_id", "col")}, col) as r
    from ({RULED})) where r = 1"""


def chosen_targets(spark, d):
    kept = P.rule_candidates(P.filter_small(probe_profile(spark, d)))
    return T.infer_task(_paths(T.choose_target(kept, SEED)))


@query("choose_target", f"select table_id, col, kind from ({CHOSEN})")
def choose_target(spark, d):
    return chosen_targets(spark, d).select("table_id", "col", "kind")


ORDER_KEY = sql_draw("balance_order", "table_id", "0")


def _balanced_sql(chosen):
    return f"""select table_id, col, task, 0 as replica from ({chosen}) union all
    select c.table_id, c.col, c.task, k from (
      select *, row_number() over (order by {ORDER_KEY}, table_id) - 1 as idx from ({chosen})
      where task = 'classification') c
    join (select k, {sql_draw("balance", "k")} % n_cls as idx from (
      select unnest(range(1, n_reg - n_cls + 1)) as k, n_cls from (
        select count(*) filter (task = 'classification') as n_cls,
          count(*) filter (task = 'regression') as n_reg from ({chosen})) where n_cls > 0)) using (idx)"""


# Every rule candidate as a spec of its own: more specs than one per table, so balancing has work.
ALL_SPECS = f"select table_id || '/' || col as table_id, col, case when kind = 'num' then 'regression' else 'classification' end as task from ({RULED})"


def all_specs(spark, d):
    kept = P.rule_candidates(P.filter_small(probe_profile(spark, d)))
    return kept.select(
        F.concat_ws("/", "table_id", "col").alias("table_id"),
        "col",
        F.when(F.col("kind") == "num", "regression").otherwise("classification").alias("task"),
    )


RARE = f"select * from ({ALL_SPECS}) where task = 'regression' or table_id like 'part%' or table_id like 'orders%'"


@query("balance_tasks", f"select table_id, col, task, replica::bigint as replica from ({_balanced_sql(RARE)})")
def balance_tasks(spark, d):
    rare = (F.col("task") == "regression") | F.col("table_id").rlike("^(part|orders)")
    return T.balance(stage(all_specs(spark, d).where(rare), "specs"), SEED).select("table_id", "col", "task", "replica")


def _ordered_sql(specs):
    key = sql_draw("spec_order", "table_id", "replica")
    return f"select *, row_number() over (order by {key}, table_id, replica) - 1 as spec_idx from ({specs})"


@query("shuffle_specs", f"select table_id, col, spec_idx from ({_ordered_sql(f'select *, 0 as replica from ({ALL_SPECS})')})")
def shuffle_specs(spark, d):
    specs = stage(all_specs(spark, d), "specs").withColumn("replica", F.lit(0).cast("bigint"))
    return T.order_specs(specs, SEED).select("table_id", "col", "spec_idx")


@query(
    "target_specs",
    f"select table_id, col, task, replica::bigint as replica, spec_idx from ({_ordered_sql(_balanced_sql(CHOSEN))})",
)
def target_specs(spark, d):
    plan = plan_corpus(spark, d)
    tables = _paths(plan.table_rows().select("table_id"))
    specs = T.build_specs(probe_cells(plan, B), tables, SEED, balanced=True)
    return specs.select("table_id", "col", "task", "replica", "spec_idx")


@query(
    "spec_replay",
    f"""select s.table_id, s.col, c.chunk_id, s.replica::bigint as replica,
        {sql_draw("sample", "s.table_id", "s.replica", "c.chunk_id")} as sample_draw
        from ({_balanced_sql(CHOSEN)}) s join (
          select distinct table_id, row_ord // 1000 as chunk_id from ({sql_numbered()})) c using (table_id)""",
)
def spec_replay(spark, d):
    specs = T.balance(stage(chosen_targets(spark, d).drop("kind"), "specs"), SEED)
    replayed = T.replay_specs(specs, plan_corpus(spark, d).chunks(B), SEED)
    return replayed.select("table_id", "col", "chunk_id", "replica", "sample_draw")


PLAIN = f"select table_id, col, case when kind = 'num' then 'regression' else 'classification' end as task from ({CHOSEN})"
SAMPLED = f"""select *, row_number() over (partition by table_id, chunk_id, replica
      order by {sql_draw("row_order", "table_id", "chunk_id", "replica", "row_ord")}, row_ord) as pos,
    count(*) over (partition by table_id, chunk_id, replica) as n from (
      select r.table_id, r.row_ord, r.row_ord // {B} as chunk_id, s.replica, s.col, s.task, c.v
      from ({sql_numbered()}) r join ({_balanced_sql(PLAIN)}) s using (table_id)
      join ({sql_cells()}) c on c.table_id = r.table_id and c.row_ord = r.row_ord and c.col = s.col)"""
SAMPLED_LOW = "greatest(1, least(50, least(900, n - 1)))"


@query(
    "corpus_samples",
    f"""select table_id, col as target_column, task, chunk_id, replica::bigint as replica, count(*) as n_rows,
        count(*) filter (is_query) as n_query, sum(row_ord) filter (is_query)::bigint as query_rows, sum(pos * row_ord)::bigint as place,
        case when task = 'classification' then least(count(distinct v) filter (not is_query), 62) end::bigint as n_codes
        from (select *, pos > n - ({SAMPLED_LOW} + {sql_draw("query_rows", "table_id", "chunk_id", "replica")}
          % (greatest(least(900, n - 1), {SAMPLED_LOW}) - {SAMPLED_LOW} + 1)) as is_query from ({SAMPLED}) where n >= 150)
        group by table_id, col, task, chunk_id, replica""",
)
def corpus_samples_query(spark, d):
    """Whole samples of the whole corpus, summed up by sample from the first cell of each row."""
    config = SampleConfig(
        query_range=(50, 900), shuffle=True, min_rows=150, max_rows=B, rows_per_chunk=B, balanced=True, seed=SEED
    )
    rows = corpus_samples(spark, d, config).where("col_pos = 0")
    code = F.when(~F.col("is_query") & (F.col("task") == "classification") & (F.col("truth") < 62), F.col("truth"))
    return rows.groupBy("table_id", "target_column", "task", "chunk_id", "replica").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_query").alias("n_query"),
        F.sum(F.when(F.col("is_query"), F.col("row_ord"))).alias("query_rows"),
        F.sum(F.col("pos") * F.col("row_ord")).alias("place"),
        F.when(F.col("task") == "classification", F.count_distinct(code)).alias("n_codes"),
    )


SPARSE = "case when (event_id // 1000) % 2 = 0 and event_id % 3 < 2 then null else value end"


@query(
    "eligible_target",
    f"""select table_id, chunk_id, task from (
        select 'events' as table_id, event_id // 1000 as chunk_id, 'regression' as task,
          count({SPARSE}) / count(*) as share, 0 as distinct_ratio from events group by 1, 2
        union all select 'customer', c_custkey // 1000, 'classification', 1, count(distinct c_mktsegment) / count(*)
          from customer group by 1, 2
        union all select 'documents', doc_id // 1000, 'classification', 1, count(distinct text) / count(*)
          from documents group by 1, 2
        union all select 'part', p_partkey // 1000, 'classification', 1, count(distinct p_brand) / count(*)
          from part group by 1, 2)
        where case when task = 'regression' then share >= 0.5 else distinct_ratio <= 0.2 end""",
)
def eligible_target(spark, d):
    sparse = (F.floor(F.col("event_id") / B) % 2 == 0) & (F.col("event_id") % 3 < 2)
    plans = (
        ("events", "event_id", "value", "regression"),
        ("customer", "c_custkey", "c_mktsegment", "classification"),
        ("documents", "doc_id", "text", "classification"),
        ("part", "p_partkey", "p_brand", "classification"),
    )
    parts = []
    for name, key, column, task in plans:
        rows = chunked(spark, d, name, key, B)
        if name == "events":
            rows = rows.withColumn("value", F.when(~sparse, F.col("value")))
        cells = scan.to_cells(rows.select(*scan.ROW_COLUMNS, column))
        parts.append(P.profile(cells, ("table_id", "chunk_id")).withColumn("task", F.lit(task)))
    fit = T.filter_eligible(scan.union_all(parts), auto=False)
    return fit.select("table_id", "chunk_id", "task")



@query(
    "cell_kinds",
    " union all ".join(
        f"select '{t}' as table_id, '{c}' as col, '{'text' if k == 'nested' else k}' as kind, count(*) as n from {t}"
        for t in TABLES
        for c, k in columns_of(t)
    ),
)
def cell_kinds(spark, d):
    cells = scan.corpus_cells(corpus(spark, d), B)
    return cells.groupBy("table_id", "col", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_non_null",
    """select event_id // 1000 as chunk_id, min(event_id) filter (event_id % 7 <> 0) as first_row,
       arg_min(event_type, event_id) filter (event_id % 7 <> 0) as first_value from events group by 1""",
)
def first_non_null(spark, d):
    rows = chunked(spark, d, "events", "event_id", B)
    rows = rows.withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    cells = scan.to_cells(rows.select(*scan.ROW_COLUMNS, "event_type"))
    return P.first_non_null(cells).select("chunk_id", "first_row", "first_value")
