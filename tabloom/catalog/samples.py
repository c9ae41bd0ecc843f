"""Queries on row sampling, splits and cell encoding."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import channels as CH
from ..functions.draws import draw
from ..operators import encode as E
from ..operators import sampling as S
from ..operators import text as X
from ..plans import vectors as V
from ..plans.encode_sample import encode
from ..plans.prepare import SampleConfig, prepare
from ..sources import dictionary as D
from ..sources.shared import fresh_path
from .registry import (
    SEED,
    big,
    chunked,
    query,
    rounded,
    sql_chunked,
    sql_draw,
    sql_split,
    table,
)

B = 1000
EDGE_SCALE = 9  # quantiles differ in the last bit between engines; compared to 9 places
RANGE = (50, 900)

# Gaps and infinite values put into events.value, the same way on both engines.
SQL_WILD = """case when event_id % 101 = 0 then 'Infinity'::double when event_id % 103 = 0 then '-Infinity'::double
    when event_id % 7 = 0 then null else value end as wild, case when event_id % 7 = 0 then null else value end as gappy"""


def split_events(spark, d):
    """Events in chunks, shuffled and split, with a gappy and a wild value column."""
    rows = chunked(spark, d, "events", "event_id", B)
    i, v = F.col("event_id"), F.col("value")
    rows = rows.select(
        "*",
        F.when(i % 101 == 0, F.lit(float("inf")))
        .when(i % 103 == 0, F.lit(float("-inf")))
        .when(i % 7 != 0, v)
        .alias("wild"),
        F.when(i % 7 != 0, v).alias("gappy"),
    )
    return S.split_context(S.order_rows(rows, SEED, shuffle=True), SEED, query_range=RANGE)


EVENTS = sql_split(sql_chunked("events", "event_id", B, SQL_WILD))


# ---- sampling -----------------------------------------------------------------------------

ORDERS = sql_chunked("orders", "o_orderkey", B)


def orders(spark, d):
    return chunked(spark, d, "orders", "o_orderkey", B)


@query(
    "sample_rows",
    f"""select o_orderkey, chunk_id, pos from (select *, row_number() over (partition by chunk_id order by
        {sql_draw("row_cap", "table_id", "chunk_id", "row_ord")}, row_ord) as pos from ({ORDERS})) where pos <= 300""",
)
def sample_rows(spark, d):
    return S.sample_rows(orders(spark, d), 300, SEED).select("o_orderkey", "chunk_id", "pos")


@query(
    "shuffle_rows",
    f"""select o_orderkey, chunk_id, row_number() over (partition by chunk_id order by
        {sql_draw("row_order", "table_id", "chunk_id", "row_ord")}, row_ord) as pos from ({ORDERS})""",
)
def shuffle_rows(spark, d):
    return S.shuffle_rows(orders(spark, d), SEED).select("o_orderkey", "chunk_id", "pos")


@query("context_query_split", f"select o_orderkey, chunk_id, pos, is_query from ({sql_split(ORDERS)})")
def context_query_split(spark, d):
    ordered = S.order_rows(orders(spark, d), SEED, shuffle=True)
    split = S.split_context(ordered, SEED, query_range=RANGE)
    return split.select("o_orderkey", "chunk_id", "pos", "is_query")


@query(
    "query_chunks",
    f"""select o_orderkey, chunk_id, (pos - fit_rows - 1) // 100 as query_chunk
        from ({sql_split(ORDERS)}) where is_query""",
)
def query_chunks(spark, d):
    ordered = S.order_rows(orders(spark, d), SEED, shuffle=True)
    split = S.split_context(ordered, SEED, query_range=RANGE)
    return S.query_chunks(split, 100).select("o_orderkey", "chunk_id", "query_chunk")


@query(
    "bootstrap_bags",
    f"""select bag, slot, o_orderkey, o_totalprice from (select b::bigint as bag, s::bigint as slot,
        {sql_draw("bootstrap", "'orders'", "b", "s")} % (select count(*) from orders) as o_orderkey
        from range(4) x(b), range(2048) y(s)) join orders using (o_orderkey)""",
)
def bootstrap_bags(spark, d):
    bags = S.bootstrap_bags(orders(spark, d), 4, 2048, SEED, max_groups=1)
    return bags.select(big("bag"), big("slot"), "o_orderkey", "o_totalprice")


def _sliding_sql(m):
    order = sql_draw("bag_order", "'orders'", "o_orderkey")
    return f"""select bag, r - start as slot, o_orderkey from (
        select *, case when b = 1 then 0 else floor((n - {m})::double / greatest(b - 1, 1) * bag)::bigint end as start from (
          select *, unnest(range(b)) as bag from (
            select o_orderkey, row_number() over (order by {order}, o_orderkey) - 1 as r,
              (select count(*) from orders) as n,
              least(16, ceil((select count(*) from orders) / {m}))::bigint as b from orders)))
        where b = 1 or (r >= start and r < start + {m})"""


@query("sliding_bags", _sliding_sql(2000))
def sliding_bags(spark, d):
    bags = S.sliding_bags(orders(spark, d), 2000, SEED, max_groups=1)
    return bags.select("bag", "slot", "o_orderkey")


@query(
    "cap_context",
    f"""select r as slot, o_orderkey from (select o_orderkey, row_number() over (order by
        {sql_draw("row_cap", "'orders'", "o_orderkey")}, o_orderkey) - 1 as r from orders) where r < 8192""",
)
def cap_context(spark, d):
    bag = S.cap_context(orders(spark, d), K.MAX_CONTEXT_ROWS, SEED, max_groups=1)
    return bag.select("slot", "o_orderkey")


@query(
    "bag_query_plan",
    """select bag, query_chunk, n_rows, first_row from (select o_orderkey // 1000 as query_chunk,
       count(*) as n_rows, min(o_orderkey) as first_row from orders group by 1), range(8) r(bag)""",
)
def bag_query_plan(spark, d):
    cut = S.table_query_chunks(table(spark, d, "orders"), K.QUERY_CHUNK_ROWS, "o_orderkey")
    chunks = cut.groupBy("query_chunk").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_row")
    )
    return S.plan_scoring(chunks, 8).withColumn("bag", F.col("bag").cast("bigint"))


@query(
    "union_context_query",
    """select event_id, is_query, event_type from (
       select event_id, event_type, false as is_query from events where value < 10 union all
       select event_id, event_type, true from events where value >= 10)""",
)
def union_context_query(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    low, high = rows.where("value < 10").drop("value"), rows.where("not value < 10").drop("value")
    return S.stack_context_query(low, high)


# ---- numbers ------------------------------------------------------------------------------

WINDOW = "over (partition by chunk_id)"
FIN = "isfinite(wild)"
SQL_CLAMPED = f"""select *, case when is_query then greatest(least(wild, qhi + 1), qlo - 1)
    else greatest(least(wild, chi + 1), clo - 1) end as clamped_any from (select *,
    min(wild) filter (is_query and {FIN}) {WINDOW} as qlo, max(wild) filter (is_query and {FIN}) {WINDOW} as qhi,
    min(wild) filter (not is_query and {FIN}) {WINDOW} as clo, max(wild) filter (not is_query and {FIN}) {WINDOW} as chi
    from ({EVENTS}))"""
SQL_CLAMP = f"select *, case when wild is null then null else clamped_any end as clamped from ({SQL_CLAMPED})"


@query("clamp_inf", f"select event_id, clamped from ({SQL_CLAMP})")
def clamp_inf(spark, d):
    out = E.clamp_inf(split_events(spark, d), ["wild"])
    return out.select("event_id", F.col("wild__clamped").alias("clamped"))


def sql_edges(source, column, bins=16, group="chunk_id"):
    at = ", ".join(str((2 * i + 1) / (2 * bins)) for i in range(bins))
    return f"""select {group}, list_transform(list_concat([min({column})], quantile_cont({column}, [{at}]), [max({column})]),
        lambda e: round(e, {EDGE_SCALE})) as edges from ({source}) where not is_query and {column} is not null group by {group}"""


def sql_bins(source, column, bins=16, group="chunk_id"):
    """Adds floor, delta, bin for ``column`` of a split source."""
    return f"""select *, case when known then i - 1 else 63 end as floor_code,
        case when known then delta0 else 0 end as delta_code,
        case when known then round_even(i - 1 + delta0, 0) end as bin_code from (
        select *, least(greatest(({column} - edges[i + 1]) / greatest(edges[i + 2] - edges[i + 1], 1e-10), 0), 1) as delta0 from (
          select s.*, e.edges, {column} is not null and e.edges is not null as known,
            least(greatest(len(list_filter(e.edges, lambda t: t <= {column})) - 1, 1), {bins - 1}) as i
          from ({source}) s left join ({sql_edges(source, column, bins, group)}) e using ({group})))"""


@query(
    "bin_edges",
    f"""select chunk_id, pos, round(edge, 6) as edge from (select chunk_id,
        unnest(range(18)) as pos, unnest(edges) as edge from ({sql_edges(EVENTS, "gappy")}))""",
)
def bin_edges(spark, d):
    edges = E.sample_edges(split_events(spark, d), "gappy", scale=EDGE_SCALE)
    return edges.select("chunk_id", F.posexplode("edges").alias("pos", "edge")).select(
        "chunk_id", big("pos"), rounded("edge")
    )


@query(
    "quantile_bin",
    f"""select event_id, is_query, floor_code::bigint as floor, round(delta_code, 6) as delta,
        bin_code::bigint as bin from ({sql_bins(SQL_CLAMP, "clamped")})""",
)
def quantile_bin(spark, d):
    out = E.quantile_bin(split_events(spark, d), ["wild"], scale=EDGE_SCALE)
    code = F.col("wild__code")
    return out.select(
        "event_id",
        "is_query",
        code["floor"].cast("bigint").alias("floor"),
        F.round(code["delta"], 6).alias("delta"),
        code["bin"].cast("bigint").alias("bin"),
    )


SQL_TAME = "case when isfinite(wild) then wild end"


def _sql_limits(source, x, lo=0.005, hi=0.995, group="chunk_id"):
    return f"select {group}, quantile_cont({x}, {lo}) as lo, quantile_cont({x}, {hi}) as hi from ({source}) where not is_query group by {group}"


@query(
    "winsor_limits",
    f"""select a.chunk_id, round(a.lo, 6) as lo, round(a.hi, 6) as hi, round(b.lo, 6) as lo2, round(b.hi, 6) as hi2
        from ({_sql_limits(EVENTS, "gappy")}) a join ({_sql_limits(EVENTS, "gappy", 0.02, 0.98)}) b using (chunk_id)""",
)
def winsor_limits(spark, d):
    x = F.col("gappy")
    limits = split_events(spark, d).groupBy("table_id", "chunk_id").agg(
        E.winsor_limits(x).alias("a"), E.winsor_limits(x, "default").alias("b")
    )
    part = lambda c, i, n: F.round(F.get(c, F.lit(i)), 6).alias(n)
    return limits.select("chunk_id", part("a", 0, "lo"), part("a", 1, "hi"), part("b", 0, "lo2"), part("b", 1, "hi2"))


def sql_round(x):
    """Rounded to 6 places without negative zero."""
    return f"case when abs({x}) < 5e-7 then 0 else round({x}, 6) end"


def sql_scaled(source, x, role, group="chunk_id"):
    """Adds m, s, z of column expression ``x`` by the rule of the role."""
    w = f"over (partition by {group})"
    if role == "feature":
        filled = f"select *, coalesce({x}, avg({x}) filter (not is_query) {w}) as f from ({source})"
        limits = _sql_limits(filled, "f", group=group)
        clipped = f"select s.*, case when f is not null then least(greatest(f, lo), hi) end as c from ({filled}) s join ({limits}) using ({group})"
    else:
        plain = f"select *, {x} as f from ({source})"
        limits = _sql_limits(plain, "f", group=group)
        cut = f"select s.*, case when f is not null then least(greatest(f, lo), hi) end as c0 from ({plain}) s join ({limits}) using ({group})"
        clipped = f"select *, coalesce(c0, avg(c0) filter (not is_query) {w}) as c from ({cut})"
    stats = f"select *, avg(c) filter (not is_query) {w} as m, stddev_pop(c) filter (not is_query) {w} as s from ({clipped})"
    return f"select *, (c - m) / case when s < 1e-9 then 1 else s end as z from ({stats})"


@query(
    "standardise",
    f"""select a.event_id, {sql_round("a.z")} as z_feature, {sql_round("b.z")} as z_target
        from ({sql_scaled(EVENTS, SQL_TAME, "feature")}) a join ({sql_scaled(EVENTS, SQL_TAME, "target")}) b using (event_id)""",
)
def standardise(spark, d):
    rows = split_events(spark, d).withColumn("other", F.col("wild"))
    out = E.standardise(E.standardise(rows, ["wild"]), ["other"], role="target")
    return out.select(
        "event_id", F.round("wild__z", 6).alias("z_feature"), F.round("other__z", 6).alias("z_target")
    )


@query(
    "scale_stats",
    " union all ".join(
        f"select chunk_id, '{role}' as role, round(any_value(m), 6) as mean, round(any_value(s), 6) as std"
        f" from ({sql_scaled(EVENTS, SQL_TAME, role)}) group by 1"
        for role in ("feature", "target")
    ),
)
def scale_stats(spark, d):
    rows = split_events(spark, d)
    parts = [
        E.scale_stats(rows, ["wild"], role=role).select(
            "chunk_id", F.lit(role).alias("role"), rounded("mean"), rounded("std")
        )
        for role in ("feature", "target")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "mean_fill",
    f"""select event_id, round(coalesce({SQL_TAME}, avg({SQL_TAME}) filter (not is_query) {WINDOW}), 6) as filled
        from ({EVENTS})""",
)
def mean_fill(spark, d):
    out = E.fill_mean(split_events(spark, d), ["wild"])
    return out.select("event_id", F.round("wild__filled", 6).alias("filled"))


# The back-scaling of a made-up prediction: the z score of the row's value, shrunk by half.
@query(
    "unscale",
    f"select event_id, round(coalesce(case when event_id % 5 <> 0 then z / 2 end, 0) * s + m, 6) as pred from ({sql_scaled(EVENTS, 'gappy', 'target')})",
)
def unscale(spark, d):
    from ..operators.scores import unscale as back

    out = E.standardise(split_events(spark, d), ["gappy"], role="target")
    halved = out.withColumn("pred", F.when(F.col("event_id") % 5 != 0, F.col("gappy__z") / 2))
    done = back(halved, "pred", "gappy__mean", "gappy__std")
    return done.select("event_id", rounded("pred"))


# ---- dates and times ----------------------------------------------------------------------


@query(
    "date_parts",
    """select event_id, case when t is null then 0 else least(greatest(year(t), 2000), 2050) - 1999 end as y,
       coalesce(month(t), 0) as m, coalesce(day(t), 0) as d, coalesce(isodow(t), 0) as w
       from (select event_id, case when event_id % 11 = 0 then null
         else ts + to_years((event_id % 90 - 45)::int) end as t from events)""",
)
def date_parts(spark, d):
    moved = F.col("ts") + F.make_ym_interval((F.col("event_id") % 90 - 45).cast("int"))
    rows = table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 11 != 0, moved))
    codes = CH.date_codes("t")
    return rows.select("event_id", *[c.cast("bigint").alias(n) for n, c in codes.items()])


@query(
    "time_seconds",
    """select event_id, round(hour(ts) * 3600 + minute(ts) * 60 + (microsecond(ts) / 1000000.0), 6)::double as from_ts,
       round(case when event_id % 13 = 0 then null else hour(ts) * 3600 + minute(ts) * 60 + second(ts) end, 6)::double as from_text,
       round(((event_id * 7919) % 86400000) / 1000.0, 6)::double as from_micros from events""",
)
def time_seconds(spark, d):
    ev = table(spark, d, "events")
    shown = F.when(F.col("event_id") % 13 == 0, F.lit("25:61:00")).otherwise(
        F.date_format("ts", "HH:mm:ss")
    )
    ev = ev.select("event_id", "ts", shown.alias("shown"), ((F.col("event_id") * 7919) % 86400000 * 1000).alias("micros"))
    kinds = {f.name: f.dataType for f in ev.schema.fields}
    secs = lambda c, n: F.round(CH.time_seconds(c, kinds[c]), 6).alias(n)
    return ev.select("event_id", secs("ts", "from_ts"), secs("shown", "from_text"), secs("micros", "from_micros"))


# ---- labels -------------------------------------------------------------------------------

LABELLED = sql_split(
    "select *, 'events' as table_id, event_id as row_ord, event_id // 1000 as chunk_id from "
    "(select * replace (case when event_id % 9 = 0 then null else props end as props) from events)"
)
SQL_COUNTS = f"""select chunk_id, label, n from (select *, row_number() over (partition by chunk_id order by n desc, label) as r
    from (select chunk_id, props as label, count(*) as n from ({LABELLED})
      where not is_query and props is not null group by 1, 2)) where r <= 62"""
SQL_MAP = f"""select chunk_id, label, row_number() over (partition by chunk_id order by
    {sql_draw("label", "'events'", "chunk_id", "label")}, label) - 1 as code from ({SQL_COUNTS})"""


def labelled_events(spark, d):
    """Events with ``props`` as a label of about 100 values and gaps."""
    gappy = F.when(F.col("event_id") % 9 != 0, F.col("props"))
    return split_events(spark, d).withColumn("props", gappy)


@query("label_counts", SQL_COUNTS)
def label_counts(spark, d):
    return E.label_counts(labelled_events(spark, d), "props").select("chunk_id", "label", "n")


def codes(spark, d):
    counts = E.label_counts(labelled_events(spark, d), "props")
    return E.label_map(counts, SEED)


@query("label_map", SQL_MAP)
def label_map(spark, d):
    return codes(spark, d).select("chunk_id", "label", big("code"))


@query(
    "label_encode",
    f"""select event_id, coalesce(m.code, 62) as code from ({LABELLED}) s
        left join ({SQL_MAP}) m on s.chunk_id = m.chunk_id and s.props = m.label""",
)
def label_encode(spark, d):
    out = E.encode_labels(labelled_events(spark, d), codes(spark, d), "props")
    return out.select("event_id", big("code"))


@query("class_list", "select distinct props as label from events")
def class_list(spark, d):
    return E.classes(table(spark, d, "events"), "props")


def sql_codes(source, label, chunk="chunk_id", name="events"):
    counts = f"""select {chunk}, {label} as label, count(*) as n from ({source}) where not is_query and {label} is not null group by 1, 2"""
    top = f"select * from (select *, row_number() over (partition by {chunk} order by n desc, label) as r from ({counts})) where r <= 62"
    return f"""select {chunk}, label, row_number() over (partition by {chunk} order by
        {sql_draw("label", f"'{name}'", chunk, "label")}, label) - 1 as code from ({top})"""


SQL_TYPE_MAP = sql_codes(EVENTS, "event_type")
SQL_CLS = f"""select s.*, coalesce(m.code, 62) as code from ({EVENTS}) s left join ({SQL_TYPE_MAP}) m
    on s.chunk_id = m.chunk_id and s.event_type = m.label"""


@query(
    "encode_target",
    f"""select event_id, 'classification' as task, case when is_query then -100 else code end::double as target,
          0.0::double as delta, code::double as truth from ({SQL_CLS})
        union all select event_id, 'bins', case when is_query then -100 else floor_code end, case when is_query then 0 else round(delta_code, 6) end, bin_code
          from ({sql_bins(EVENTS, "gappy")})
        union all select event_id, 'l2', case when is_query then -100 else {sql_round("z")} end, 0, {sql_round("z")} from ({sql_scaled(EVENTS, "gappy", "target")})""",
)
def encode_target(spark, d):
    rows = split_events(spark, d)
    parts = [
        E.encode_target(rows, "event_type", "classification", seed=SEED).withColumn("task", F.lit("classification")),
        E.encode_target(rows, "gappy", "regression", scale=EDGE_SCALE).withColumn("task", F.lit("bins")),
        E.encode_target(rows, "gappy", "regression", regression="l2").withColumn("task", F.lit("l2")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(
        "event_id", "task", rounded("target"), F.round("target_delta", 6).alias("delta"), rounded("truth")
    )


# ---- whole samples ------------------------------------------------------------------------

CONFIG = SampleConfig(query_range=RANGE, shuffle=True, max_rows=800, max_columns=6, pad=8, seed=SEED)


def raw_events(spark, d):
    """Events chunks with one constant and one never-filled column and ``value`` last."""
    rows = chunked(spark, d, "events", "event_id", B)
    return rows.select(
        "table_id", "chunk_id", "row_ord", "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("value") * 2).alias("twice"),
        F.lit("same").alias("fixed"), F.lit(None).cast("double").alias("never"), "props", "value",
    )


SQL_RAW = """select event_id, ts, user_id, event_type, case when event_id % 7 = 0 then null else value * 2 end as twice,
    'same' as fixed, null::double as never, props, value, 'events' as table_id, event_id as row_ord,
    event_id // 1000 as chunk_id from events"""
SQL_CAPPED = f"""select * exclude (capped) from (select *, row_number() over (partition by chunk_id order by
    {sql_draw("row_cap", "table_id", "chunk_id", "row_ord")}, row_ord) as capped from ({SQL_RAW})) where capped <= 800"""
SQL_PREPARED = sql_split(SQL_CAPPED)
RAW_FEATURES = ["event_id", "ts", "user_id", "event_type", "twice", "fixed", "never", "props"]
# 'never' has no value at all, so it is not constant; six columns allow five features and the target.
SQL_PLAN = f"""select chunk_id, col, nth as pos from (
    select chunk_id, col, row_number() over (partition by chunk_id order by pick, src) - 1 as nth from (
    select *, {sql_draw("feature", "'events'", "chunk_id", "col")} as pick from (
    {' union all '.join(
        f"select chunk_id, '{c}' as col, {i} as src, count(distinct {c}) as k from ({SQL_PREPARED}) group by 1"
        for i, c in enumerate(RAW_FEATURES))}) where k <> 1)) where nth < 5"""


@query(
    "prepare_sample",
    f"""select s.event_id, s.chunk_id, s.pos, s.is_query, c.cols as columns from ({SQL_PREPARED}) s join (
        select chunk_id, string_agg(col, ',' order by pos) || ',__LOOM_PAD_05__,__LOOM_PAD_06__,__LOOM_PAD_07__' as cols
        from ({SQL_PLAN}) group by 1) c using (chunk_id)""",
)
def prepare_sample(spark, d):
    rows, _ = prepare(raw_events(spark, d), "value", CONFIG)
    names = F.array_join(F.transform("columns", lambda c: c["col"]), ",")
    return rows.select(
        F.col("event_id").cast("bigint"), "chunk_id", "pos", "is_query", names.alias("columns")
    )


def _encode_check():
    target = f"select chunk_id, event_id, case when is_query then -100 else floor_code end as target, bin_code from ({sql_bins(SQL_PREPARED, 'value')})"
    none = "-100.0::double"

    def cell(c):
        head = f"select chunk_id, row_ord, pos, is_query, '{c}' as col"
        zero = "0 as y, 0 as m, 0 as d, 0 as w"
        if c in ("event_id", "user_id", "twice"):
            return f"{head}, null as txt, floor_code::double as floor, round(delta_code, 6) as delta, {zero} from ({sql_bins(SQL_PREPARED, c)})"
        if c == "ts":
            return f"""{head}, null as txt, {none}, 0.0, year(ts) - 2000 + 1, month(ts), day(ts), isodow(ts) from ({SQL_PREPARED})"""
        return f"{head}, coalesce({c}::varchar, 'None') as txt, {none}, 0.0, {zero} from ({SQL_PREPARED})"

    cells = " union all ".join(cell(c) for c in RAW_FEATURES if c != "never")
    pads = f"select chunk_id, row_ord, pos, is_query, printf('__LOOM_PAD_%02d__', i) as col, '__LOOM_PAD__' as txt, {none} as floor, 0.0 as delta, 0 as y, 0 as m, 0 as d, 0 as w from ({SQL_PREPARED}), range(5, 8) r(i)"
    return f"""select row_ord, x.pos, col, col_pos, txt, floor, delta, y, m, d, w, t.target::double as target from (
        select c.*, p.pos as col_pos from ({cells}) c join ({SQL_PLAN}) p using (chunk_id, col)
        union all select *, replace(replace(col, '__LOOM_PAD_', ''), '__', '')::bigint from ({pads})) x
        join ({target}) t on x.row_ord = t.event_id"""


@query("encode_sample", _encode_check)
def encode_sample(spark, d):
    rows, kind = prepare(raw_events(spark, d), "value", CONFIG)
    cells = encode(rows, kind, "value", "regression", seed=SEED, scale=EDGE_SCALE)
    return cells.select(
        "row_ord", "pos", "col", big("col_pos"), "txt", rounded("floor"), rounded("delta"),
        *[big(p) for p in "ymdw"], rounded("target"),
    )


# ---- text ---------------------------------------------------------------------------------

SQL_TEXTS = """select text as txt from conversations union all select role from conversations
    union all select event_type from events union all select props from events
    union all select text from documents"""


def all_texts(spark, d):
    pick = lambda t, c: table(spark, d, t).select(F.col(c).alias("txt"))
    parts = [
        pick("conversations", "text"), pick("conversations", "role"), pick("events", "event_type"),
        pick("events", "props"), pick("documents", "text"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("distinct_texts", f"select sha256(txt) as text_id, txt from (select distinct txt from ({SQL_TEXTS}))")
def distinct_texts(spark, d):
    return X.distinct_texts(all_texts(spark, d))


@query(
    "missing_texts",
    f"""select sha256(txt) as text_id, txt from (select distinct txt from ({SQL_TEXTS}))
        where txt not in (select text from conversations)""",
)
def missing_texts(spark, d):
    known = X.distinct_texts(table(spark, d, "conversations").withColumnRenamed("text", "txt"))
    return X.missing_texts(X.distinct_texts(all_texts(spark, d)), known)


def sql_embed(source, text):
    """(txt, bucket, value) of the hashed token counts at unit length, nonzero entries only."""
    return f"""select txt, b, n / sqrt(sum(n * n) over (partition by txt)) as v from (
        select txt, {sql_draw("token", "tok", seed=0)} % 64 as b, count(*) as n from (
          select txt, unnest(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}]+')) as tok
          from (select distinct {text} as txt from ({source}))) where tok <> '' group by 1, 2)"""


@query(
    "hash_embed",
    f"""select sha256(t.txt) as text_id, coalesce(round(sum(v * (b + 1)), 6), 0) as checksum,
        coalesce(round(sum(v * v), 6), 0) as norm, count(b) as filled
        from (select distinct txt from ({SQL_TEXTS})) t left join ({sql_embed(SQL_TEXTS, "txt")}) e on t.txt = e.txt group by t.txt""",
)
def hash_embed(spark, d):
    vectors = X.hash_embed(X.distinct_texts(all_texts(spark, d)))
    one = vectors.select("text_id", F.posexplode("vec").alias("b", "v"))
    return one.groupBy("text_id").agg(
        F.round(F.sum(F.col("v") * (F.col("b") + 1)), 6).alias("checksum"),
        F.round(F.sum(F.col("v") * F.col("v")), 6).alias("norm"),
        F.count_if(F.col("v") != 0).alias("filled"),
    )


@query(
    "text_dictionary",
    f"""select c.conv_id, c.turn, c.role, round(sum(e.v * (e.b + 1)), 6) as checksum from conversations c
        join ({sql_embed("select role from conversations", "role")}) e on c.role = e.txt group by 1, 2, 3
        union all select c.conv_id, c.turn, 'text', coalesce(round(sum(e.v * (e.b + 1)), 6), 0) from conversations c
        left join ({sql_embed("select text from conversations", "text")}) e on c.text = e.txt group by 1, 2""",
)
def text_dictionary(spark, d):
    conv = table(spark, d, "conversations")
    cells = conv.select(
        "conv_id", "turn",
        F.inline(F.array(
            F.struct(F.col("role").alias("role"), F.col("role").alias("txt")),
            F.struct(F.lit("text").alias("role"), F.col("text").alias("txt")),
        )),
    )
    dictionary = X.hash_embed(X.distinct_texts(cells))
    attached = X.attach_text(cells, dictionary)
    weighted = F.aggregate(
        F.transform("vec", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return attached.select("conv_id", "turn", "role", F.round(weighted, 6).alias("checksum"))


@query(
    "first_occurrence",
    """select chunk_id, props, first_row, row_number() over (partition by chunk_id order by first_row) - 1 as ordinal
       from (select event_id // 1000 as chunk_id, props, min(event_id) as first_row from events group by 1, 2)""",
)
def first_occurrence(spark, d):
    out = X.first_occurrence(chunked(spark, d, "events", "event_id", B), "props")
    return out.select("chunk_id", "props", "first_row", "ordinal")


# Two buckets only, so that label vectors collide in some chunks.
@query(
    "label_disambiguation",
    f"""select chunk_id, event_type as label, ordinal, collides, case when collides then ordinal || '_' || event_type else event_type end as label_text
        from (select *, row_number() over (partition by chunk_id order by first_row) - 1 as ordinal,
          len(list_distinct(list(b) over (partition by chunk_id))) < count(*) over (partition by chunk_id) as collides from (
          select event_id // 1000 as chunk_id, event_type, min(event_id) as first_row, any_value({sql_draw("token", "event_type", seed=0)} % 2) as b
          from events group by 1, 2))""",
)
def label_disambiguation(spark, d):
    rows = chunked(spark, d, "events", "event_id", B).withColumn("txt", F.col("event_type"))
    dictionary = X.hash_embed(X.distinct_texts(rows), dims=2)
    attached = X.attach_text(rows, dictionary)
    out = X.disambiguate_labels(attached, "event_type", "vec")
    return out.select("chunk_id", F.col("event_type").alias("label"), "ordinal", "collides", "label_text")


# ---- vectors of samples -------------------------------------------------------------------

SQL_LABELS = f"""select chunk_id, event_type, case when len(list_distinct(list(b) over (partition by chunk_id))) < count(*) over (partition by chunk_id)
      then (row_number() over (partition by chunk_id order by first_row) - 1) || '_' || event_type else event_type end as txt
    from (select chunk_id, event_type, min(row_ord) as first_row, any_value({sql_draw("token", "event_type", seed=0)} % 2) as b
      from ({SQL_PREPARED}) group by 1, 2)"""


def _vectors_check():
    cells = f"select row_ord, col, txt, col as name from ({_encode_check()})"
    labels = f"select s.row_ord, 'event_type' as col, case when not s.is_query then m.txt end as txt, null as name from ({SQL_PREPARED}) s join ({SQL_LABELS}) m using (chunk_id, event_type)"
    both = f"{cells} union all {labels}"
    sums = f"select txt, round(sum(v::float::double * (b + 1)), 6) as s from ({{}}) group by 1"
    texts, names = (sums.format(sql_embed(f"select {c} from ({both}) where {c} is not null", c)) for c in ("txt", "name"))
    return f"""select x.row_ord, x.col, case when x.txt is not null then coalesce(t.s, 0) end as txt_sum, n.s as name_sum
        from ({both}) x left join ({texts}) t on x.txt = t.txt left join ({names}) n on x.name = n.txt"""


# Label vectors have two values only, so that they collide; the told apart labels are embedded.
@query("encode_sample_vectors", _vectors_check)
def encode_sample_vectors(spark, d):
    keys = ("table_id", "chunk_id")
    rows, kind = prepare(raw_events(spark, d), "value", CONFIG)
    cells = encode(rows, kind, "value", "regression", seed=SEED, scale=EDGE_SCALE)
    rows, kind = prepare(raw_events(spark, d), "event_type", CONFIG)
    collide = lambda c: F.array(draw(0, "token", c) % 2)
    labelled = encode(rows, kind, "event_type", "classification", seed=SEED, scale=EDGE_SCALE, label_vector=collide)
    labelled = labelled.where("col_pos = 7").withColumn("col", F.lit("event_type"))  # the last cell of a row is padding
    shown = ("row_ord", "col", "txt", "target_text")
    both = cells.select(*keys, *shown, F.lit(False).alias("label")).unionByName(
        labelled.select(*keys, *shown, F.lit(True).alias("label"))
    )
    vectors = V.sample_vectors(both, keys)
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x), 6)
    out = V.inline_vectors(both, vectors, keys)
    return out.select(
        "row_ord", "col", total(F.when(F.col("label"), F.col("target_text_vec")).otherwise(F.col("txt_vec"))).alias("txt_sum"),
        total(F.when(~F.col("label"), F.col("col_vec"))).alias("name_sum"),
    )


# ---- growing dictionary -------------------------------------------------------------------


@query(
    "dictionary_versions",
    f"""select sha256(t.txt) as text_id, case when t.txt in (select text from conversations) then 'run1' else 'run2' end as version,
        coalesce(round(sum(v::float::double * (b + 1)), 6), 0) as checksum
        from (select distinct txt from ({SQL_TEXTS}) where txt is not null) t left join ({sql_embed(SQL_TEXTS, "txt")}) e on t.txt = e.txt group by t.txt""",
)
def dictionary_versions(spark, d):
    """Three runs: the texts of one table, those of all tables, and the same again."""
    path = fresh_path(spark, "dictionary")
    first = X.distinct_texts(table(spark, d, "conversations").withColumnRenamed("text", "txt"))
    every = X.distinct_texts(all_texts(spark, d))
    for run, texts in (("run1", first), ("run2", every), ("run3", every)):
        D.grow_dictionary(spark, path, texts, version=run)
    weighted = F.transform("vec", lambda v, i: v.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
    return D.known_vectors(spark, path).select("text_id", "version", F.round(total, 6).alias("checksum"))
