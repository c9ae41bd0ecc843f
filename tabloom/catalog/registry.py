"""Registered queries, each next to the SQL that checks it on another engine."""

from pyspark.sql import functions as F

from ..sources.scan import cut_chunks, named_table

SEED = 42
QUERIES = {}
CHECKS = {}

TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders "
    "pages part region supplier"
).split()

# Column kinds of the given tables, in column order; "nested" is text made of an array.
COLUMNS = {
    "benchmark": "item_id:num text:text",
    "conversations": "conv_id:num turn:num role:text text:text",
    "customer": "c_custkey:num c_name:text c_nationkey:num c_acctbal:num c_mktsegment:text",
    "documents": "doc_id:num text:text lang:text source:text n_chars:num",
    "embeddings": "vec_id:num embedding:nested label:num",
    "events": "event_id:num ts:date user_id:num event_type:text value:num props:text",
    "labels": "doc_id:num quality:num toxic:num",
    "lineitem": "l_orderkey:num l_partkey:num l_suppkey:num l_linenumber:num l_quantity:num "
    "l_extendedprice:num l_discount:num l_tax:num l_returnflag:text l_linestatus:text "
    "l_shipdate:date",
    "nation": "n_nationkey:num n_name:text n_regionkey:num",
    "orders": "o_orderkey:num o_custkey:num o_orderstatus:text o_totalprice:num o_orderdate:date "
    "o_orderpriority:text",
    "pages": "page_id:num url:text html:text",
    "part": "p_partkey:num p_name:text p_brand:text p_type:text p_size:num p_retailprice:num",
    "region": "r_regionkey:num r_name:text",
    "supplier": "s_suppkey:num s_name:text s_nationkey:num s_acctbal:num",
}


def columns_of(table):
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


def query(name, check=None):
    def register(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check() if callable(check) else check
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunked(spark, sf_dir, name, key, size):
    """A given table with table_id, row_ord and chunk_id, by its dense key."""
    return cut_chunks(named_table(table(spark, sf_dir, name), name, F.col(key)), size)


def big(col):
    return F.col(col).cast("bigint").alias(col)


def rounded(col, places=6):
    return F.round(F.col(col), places).alias(col)


# ---- SQL pieces ---------------------------------------------------------------------------


def sql_draw(purpose, *keys, seed=SEED):
    parts = ", ".join([f"'{seed}'" if isinstance(seed, int) else seed, f"'{purpose}'", *[f"({k})::varchar" for k in keys]])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::bigint"


def sql_chunked(name, key, size, extra=""):
    """CTE body: rows of a table with table_id, row_ord, chunk_id; ``extra`` select items."""
    more = f", {extra}" if extra else ""
    return (
        f"select *{more}, '{name}' as table_id, {key} as row_ord, {key} // {size} as chunk_id from {name}"
    )


def sql_split(source, lo=50, hi=900):
    """CTE body: shuffled order and random query size per chunk."""
    order = sql_draw("row_order", "table_id", "chunk_id", "row_ord")
    pick = sql_draw("query_rows", "table_id", "chunk_id")
    top = f"least({hi}, n_rows - 1)"
    low = f"greatest(1, least({lo}, {top}))"
    return f"""select *, pos > fit_rows as is_query from (
      select *, n_rows - ({low} + {pick} % (greatest({top}, {low}) - {low} + 1)) as fit_rows from (
        select *, row_number() over (partition by table_id, chunk_id order by {order}, row_ord) as pos,
          count(*) over (partition by table_id, chunk_id) as n_rows from ({source})))"""


def sql_numbered():
    """All given tables as (table_id, row_ord, columns as text) is not possible in one schema, so
    this gives one (table_id, row_ord) relation over all of them, in file order."""
    return " union all ".join(
        f"select '{t}' as table_id, row_number() over () - 1 as row_ord from {t}" for t in TABLES
    )


def sql_cells(limit=None):
    """All cells of all given tables: (table_id, col, col_ord, kind, txt, num, ts, v)."""
    parts = []
    for t in TABLES:
        where = f" where _row < {limit}" if limit else ""
        src = f"(select *, row_number() over () - 1 as _row from {t})"
        for i, (c, k) in enumerate(columns_of(t)):
            txt = f"{c}" if k == "text" else "null::varchar"
            num = f"{c}::double" if k == "num" else "null::double"
            ts = f"{c}::timestamp" if k == "date" else "null::timestamp"
            kind = "text" if k == "nested" else k
            parts.append(
                f"select '{t}' as table_id, '{c}' as col, {i} as col_ord, '{kind}' as kind, _row as row_ord, "
                f"{txt} as txt, {num} as num, {ts} as ts, {c}::varchar as v from {src}{where}"
            )
    return " union all ".join(parts)


def sql_profile(limit=None):
    return f"""select table_id, col, any_value(col_ord) as col_ord, any_value(kind) as kind,
      count(*) as n_rows, count(v) as n_present, count(distinct v) as n_distinct,
      coalesce(max(length(txt)), 0) as max_chars,
      (count(*) - count(v)) / count(*) as null_ratio, count(distinct v) / count(*) as distinct_ratio
      from ({sql_cells(limit)}) group by table_id, col"""
