"""The registered queries of this subpackage and the SQL that checks them."""

import zlib

from pyspark.sql import functions as F

from .conversations import repair_reports
from .decontaminate import mark_documents
from .jaccard import jaccard_components
from .langid import identify
from .licenses import BASE, COMMON, TEMPLATES, key_offset, scan_licences
from .mixing import Level, MixPlan, measure, mix
from .periodic import find_runs
from .pieces import encode_pieces
from .quality import score_lines
from .sharding import shard_rows
from .substrings import remove_repeats
from .tokens import token_files
from .warc import archive_pages

QUERIES, CHECKS = {}, {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name, check=None):
    def register(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


SQL_BLANK_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_PLAIN_WORDS = (
    "list_filter(string_split_regex("
    + SQL_LOWER
    + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)


QUALITY_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, {SQL_BLANK_WORDS} as w from documents),
grams as (select rid, i, list_slice(w, i, i + 2) as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select rid, i from grams qualify count(*) over (partition by rid, g) > 1),
spots as (select rid, count(distinct i + o) as n from (select rid, i, unnest([0, 1, 2]) as o from twice) group by rid),
lines as (select rid, line, row_number() over (partition by rid) as k from
  (select rid, unnest(string_split(text, chr(10))) as line from d)),
sized as (select rid, line,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as nw,
  len(regexp_extract_all(line, '[|»›•·]|>>|::')) as ns,
  len(regexp_extract_all(line, '[!-/:-@\[-`{{-~»›•·]')) as nm,
  length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as nc,
  regexp_matches(line, '[.!?:;…。]["''”’»)\]]*[\x20\x09-\x0D]*$') as ended,
  regexp_matches(line, '(?i)all rights reserved|cookie (policy|settings|notice)|uses cookies|accept cookies|privacy policy|terms (of|and) (use|service|conditions)|javascript (is|must be|seems)|enable javascript|lorem ipsum|click here|share this (page|post|article)|subscribe (now|to our)|sign up for|back to top|skip to content') as stock
  from lines),
judged as (select *, nw > 0 and ((nw < 4 and not ended) or (nw >= 5 and 100 * nm > 20 * nc)
  or (ns >= 3 and ns * 4 >= nw) or stock) as bad from sized),
per_line as (select rid, count(*) as n_lines, count(*) filter (where bad) as n_failed_lines,
  coalesce(sum(nc) filter (where bad), 0)::bigint as lost_chars,
  (count(*) filter (where nw > 0) - count(distinct case when nw > 0 then line end))::bigint as n_dup_lines
  from judged group by rid),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words, n_lines, n_failed_lines, lost_chars
  from d join per_line using (rid) left join spots using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 50 * word_chars as kept,
  n_lines, n_failed_lines, lost_chars from m
"""


@query("op1_quality_rules", QUALITY_SQL)
def quality_rules(spark, sf_dir):
    return score_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_lines", "n_failed_lines", "lost_chars",
    )


DECONTAMINATION_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {SQL_PLAIN_WORDS.format('text')} as w from documents),
b as (select item_id, {SQL_PLAIN_WORDS.format('text')} as w from benchmark),
items as (select item_id::varchar as item, w, least(len(w), 10) as width from b where len(w) > 0),
win as (select distinct item, width, list_slice(w, i, i + width - 1) as g
  from (select item, w, width, unnest(range(1, len(w) - width + 2)) as i from items)),
places as (select rid, i, width, list_slice(w, i, i + width - 1) as g
  from (select rid, w, width, unnest(range(1, len(w) - width + 2)) as i
    from d cross join (select distinct width from win))),
hits as (select rid, i, p.width, item from places p join win on p.g = win.g and p.width = win.width),
covered as (select rid, count(distinct i + o) as n_hit from
  (select rid, i, unnest(range(0, width)) as o from hits) group by rid),
listed as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names
  from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (rid) left join listed using (rid)
"""


@query("op10_benchmark_decontamination", DECONTAMINATION_SQL)
def benchmark_decontamination(spark, sf_dir):
    marked = mark_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return marked.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


# Sources in four domains by their number; weights are parts of their family.
DOMAIN = "get(array('web', 'books', 'code', 'news'), cast(try_cast(substring(source, 4) as int) div 5 as int))"


def mix_plan(prefix=""):
    """The plan of the query; a prefix keeps its level columns apart from those of the table."""
    return MixPlan(
        levels=(
            Level(f"{prefix}domain", DOMAIN, {"web": 40, "books": 30, "code": 20, "news": 10}),
            Level(f"{prefix}lang", "lang", {"en": 50, "de": 20, "fr": 20, "es": 10}),
            Level(f"{prefix}source", "source"),
        )
    )


SQL_MIX_SHARE = """
select *, case when ok then cap else (w * (b - cf)) // (wa - wf) end as got from (
  select *, sum(case when ok then cap else 0 end) over (partition by {parent})::bigint as cf,
    sum(case when ok then w else 0 end) over (partition by {parent})::bigint as wf from (
    select *, bool_and(cap * (wa - wb) <= w * (b - cb)) over (partition by {parent} order by cap / w, {node}) as ok from (
      select *, sum(w) over (partition by {parent})::bigint as wa,
        coalesce(sum(cap) over (partition by {parent} order by cap / w, {node} rows between unbounded preceding and 1 preceding), 0)::bigint as cb,
        coalesce(sum(w) over (partition by {parent} order by cap / w, {node} rows between unbounded preceding and 1 preceding), 0)::bigint as wb
      from ({children}))))
"""


def _mix_sql():
    weights = {
        "domain": "case domain when 'web' then 40 when 'books' then 30 when 'code' then 20 when 'news' then 10 else 1 end",
        "lang": "case lang when 'en' then 50 when 'de' then 20 when 'fr' then 20 when 'es' then 10 else 1 end",
        "source": "1",
    }
    path, ctes, above = [], [], "(select sum(tokens)::bigint * 80 // 100 as got from leaf)"
    for name, w in weights.items():
        parent = ", ".join(path) or "0"
        on = f"using ({', '.join(path)})" if path else "on true"
        path.append(name)
        children = (
            f"select {', '.join('n.' + c for c in path)}, n.cap, n.w, a.got as b from (select {', '.join(path)}, "
            f"sum(tokens)::bigint * 2 as cap, ({w})::bigint as w from leaf group by {', '.join(path)}) n join {above} a {on}"
        )
        ctes.append(f"b_{name} as ({SQL_MIX_SHARE.format(parent=parent, node=name, children=children)})")
        above = f"b_{name}"
    return f"""
with d as (select doc_id, md5(coalesce(text, '')) as t, coalesce(lang, '') as lang, coalesce(source, '') as source,
  coalesce(['web', 'books', 'code', 'news'][cast(substring(source, 4) as int) // 5 + 1], '') as domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
{', '.join(ctes)},
plan as (select domain, lang, source, f, case when f < 2 then got - f * tokens end as rest from (
  select domain, lang, source, got, tokens, case when tokens > 0 then least(got // tokens, 2) else 0 end as f
  from leaf join b_source using (domain, lang, source))),
p as (select d.*, f, rest, sum(n_tokens) over (partition by domain, lang, source
    order by md5(concat_ws(':', '42', f::varchar, doc_id::varchar, t)), doc_id rows unbounded preceding) as upto
  from d join plan using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens, unnest(range(0, f))::int as epoch from p
union all select doc_id, domain, lang, source, n_tokens, f::int from p where upto <= rest
"""


@query("op5_source_mixing", _mix_sql())
def source_mixing(spark, sf_dir):
    plan = mix_plan()
    measured = measure(table(spark, sf_dir, "documents"), plan).drop("text", "n_chars")
    return mix(measured, plan).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _licence_sql():
    def values(rows):
        return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

    phrases = [("base", label, p, 0) for p, label in BASE.items()]
    phrases += [("key", t, key, key_offset(t)) for t, (_, key) in TEMPLATES.items()]
    postings = [(t, k, w) for t, (text, _) in TEMPLATES.items() for k, w in enumerate(text.split()) if w not in COMMON]
    return f"""
with d as (select row_number() over () as rid, doc_id, {SQL_PLAIN_WORDS.format('text')} as w from documents),
places as (select rid, unnest(w) as word, unnest(range(0, len(w))) as pos from d),
phrase as (select kind, label, string_split(p, ' ') as q, away from (values {values(phrases)}) v(kind, label, p, away)),
found as (select rid, kind, label, pos, pos - away as shift from places join phrase on word = q[1] join d using (rid)
  where list_slice(w, pos + 1, pos + len(q)) = q),
base as (select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word,
  list(distinct label) as labels from found where kind = 'base' group by rid),
post as (select * from (values {values(postings)}) v(template, spot, word)),
size as (select template, least(5, count(distinct word)) as most from post group by template),
hits as (select rid, word, pos from places where word in (select word from post)),
spread as (select word, count(distinct rid) as n from hits group by word),
rare as (select rid, template, word, spot, pos from hits join spread using (word) join post using (word)
  qualify dense_rank() over (partition by rid, template order by n, word) <= 5),
votes as (select rid, template, pos - spot as shift, count(distinct word) as shared from rare group by all),
best as (select rid, template, max(shared / most) as share from votes join size using (template)
  where shared >= least(most, 3) and (rid, template, shift) in (select rid, label, shift from found where kind = 'key') group by all),
ok as (select rid, list(template) as names, max(share) as share, count(*) as n from best group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(names, [])))), ',') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0) end::double as score, coalesce(n, 0)::bigint as n_templates
from d left join base using (rid) left join ok using (rid)
"""


@query("op6_license_scans", _licence_sql())
def license_scans(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_lpt_sharding")
def lpt_sharding(spark, sf_dir):
    placed = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def vocabulary():
    """The byte-level vocabulary named by the contract, from where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_token_files")
def token_id_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), vocabulary())


@query("op3_warc_normaliser")
def warc_normaliser(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_language_id")
def language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


JACCARD_SQL = f"""
with recursive d as (select doc_id, list_filter(string_split_regex({SQL_LOWER.format('text')}, '[\\x20\\x09-\\x0D]+'),
  lambda w: w <> '') as w from documents),
s as (select distinct doc_id, list_slice(w, i, i + 4) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as (select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 75 * (x.n + y.n - i)),
reach(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, b from reach r join link on r.other = a)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id
from reach left join n using (doc_id) group by doc_id
"""


@query("op7_ngram_jaccard", JACCARD_SQL)
def ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = f"""
with d as (select doc_id, {SQL_BLANK_WORDS} as w from documents),
win as (select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
hit as (select doc_id, i, min(doc_id) over (partition by h) < doc_id as again from win),
gone as (select doc_id, list(distinct i + o) as places from
  (select doc_id, i, unnest(range(0, 50)) as o from hit where again) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
  sha256(array_to_string(case when places is null then w else
    list_filter(w, lambda x, i: not list_contains(places, i)) end, ' ')) as kept_sha256
from d left join gone using (doc_id)
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def substring_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def repeat_tail(doc_id, words):
    """Words with the tail of every tenth document, by the checksum of its id, made periodic."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def sha256_text(column):
    return F.sha2(column.cast("binary"), 256)


@query("op11_periodic_runs")
def periodic_runs(spark, sf_dir):
    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), prepare=repeat_tail)
    none = F.struct(*[F.lit(None).cast("bigint").alias(x) for x in ("start", "length", "period")])
    # Runs come by start, then period, so only a greater ratio takes the place of the one held.
    best = F.aggregate(
        "runs", none, lambda b, x: F.when(b.start.isNull() | (x.length * b.period > b.length * x.period), x).otherwise(b)
    )
    listed = F.transform("runs", lambda x: F.concat_ws(",", x.start, x.length, x.period))
    runs_text = F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumns({"best": best, "runs_text": runs_text})
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha256_text(F.col("runs_text")).alias("runs_sha256"), sha256_text(F.col("collapsed_text")).alias("collapsed_sha256"),
        "n_words",
    )


def piece_model():
    """The piece model named by the contract, from where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_sentence_pieces")
def sentence_pieces(spark, sf_dir):
    encoded = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return encoded.select(
        "doc_id", "n_tokens", sha256_text(F.array_join("ids", ",")).alias("ids_sha256"),
        sha256_text(F.col("decoded")).alias("decoded_sha256"),
    )


def damaged(turns):
    """Turns with the faults of the contract, by the checksum of conversation and turn; copies counts rows."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.col("_kind")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    turns = turns.withColumn("_kind", F.crc32(name.cast("binary")) % 20)
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


@query("op13_conversation_repair")
def conversation_repair(spark, sf_dir):
    return repair_reports(damaged(table(spark, sf_dir, "conversations")))
