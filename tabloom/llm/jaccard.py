"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is its set of distinct 5-word shingles. Shingles have one global order, rare before
frequent. Two sets of the wanted similarity share at least l shingles among the first
n - ceil(t n) + l of each, for any l. Each document takes, of 1 and some parts of n, the l with the
least estimated cost: the postings its prefix would meet, plus verifications, of which there are at most
(postings met) / l. A document whose prefix for some l holds fewer than l shingles that anyone shares
has no partner. A pair is verified once it shares as many prefix shingles as the smaller l of
the two; verification counts the whole sets.

Steps, all distributed:

1. Shingle hashes by NumPy per text; each batch reports its most frequent shingles, and the most
   frequent of the whole table (``HOT`` at most) go last in the order. The order never changes results.
2. A set is a node, named by 64 bits of its digest; copies are one node and never paired.
3. Prefix shingles with a single owner are dropped; costs choose l for each node.
4. Each node is verified against one promising partner, the one with most shared shingles among the
   nodes with the least private prefix in its posting lists. Links found connect large groups of
   near copies, so that step 5 need not pair their members with each other.
5. All pairs of different groups that share enough prefix shingles are verified. Posting lists are
   kept in bounded blocks per group, so no task holds a whole list. Before a pair becomes a row, two
   bounds must allow the link: the shingles nobody else has, and the parity marks of the sets (each
   shingle flips one of ``MARK_BITS`` bits; sets differ by at least the number of bits that differ).
   Most of what is left are near misses, so the sets of a pair meet by 16 bits of each shingle first:
   what these share, and how often they coincide within a set, bounds what the sets share.
6. Components of all links, by star contraction.

Sets are not stored for all documents: those of candidate pairs are computed again from the texts.
A bitmap of fixed size keeps most others from being sent; where it is full, more is sent, no less found.

Components are exact: only pairs already connected are left unverified. Shingles are compared by
64-bit hashes, as are sets (among n different sets, n^2 / 2^65 collisions are expected).

Defined cases: a null or blank text has no shingles and its own id as component; fewer than five
words are one shingle; repeated rows and copies share a component; null ids are members, never the
smallest id (a component of null ids only has a null id); extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stage
from .components import components
from .shingles import shingle_sets
from .words import apart, whole

PERCENT = 75
WORDS = 5
PARTS = (None, 64, 32, 16)  # needs: 1, and these parts of the set
VERIFY_COST = 50
HOT = 65_536
SPREAD = 1_024  # tasks at most that share the owners of one frequent shingle
BLOCK = 256
AT_ONCE = 1 << 17  # pairs of entries compared in one step
COUNTED = 1 << 21  # pairs a task holds before it gives them out
ENTRY = ("node", "g", "n", "most", "need", "mark")
FILTER_BITS = 1 << 24
MARK_BITS = 512
SHORT = 1 << 16


def _sets(batch, n_words):
    return shingle_sets(batch.column(batch.schema.get_field_index("text")), n_words)


def _node(s):
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _mark(s):
    """Parity bits of a set: bit i tells whether an odd number of its shingles fall on i."""
    odd = np.bincount((s % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _lists(parts):
    values = pa.array(np.concatenate([*parts, np.zeros(0, dtype=np.int64)]))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)


def _must(n, percent):
    """Shingles a set of n shares at least with any that is similar enough."""
    return (n * percent + 99) // 100


def _needs(n):
    """Shared shingles a prefix may ask for, in ascending order, as integer columns or arrays."""
    return [F.lit(1) if p is None else F.greatest(F.floor(n / p), F.lit(1)).cast("int") for p in PARTS]


def _key():
    return F.xxhash64("text").alias("key")


def survey(docs, n_words=WORDS):
    """(doc_id, key, n, node, mark, token, times): a row per document, key being its text's hash, and
    with n = -1 the frequent shingles of each batch."""

    def look(batches):
        for batch in batches:
            sets = _sets(batch, n_words)
            token, times = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_counts=True)
            often = times >= max(3, len(sets) // 1000)
            token, times = token[often].view(np.int64), times[often]
            k = len(token)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.concat_arrays([batch.column(0), pa.nulls(k, pa.int64())]),
                    "key": pa.concat_arrays([batch.column(2), pa.nulls(k, pa.int64())]),
                    "n": pa.array([len(s) for s in sets] + [-1] * k, pa.int32()),
                    "node": pa.array([_node(s) if len(s) else None for s in sets] + [None] * k, pa.int64()),
                    "mark": pa.array([_mark(s) if len(s) else None for s in sets] + [None] * k, pa.binary()),
                    "token": pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(token)]),
                    "times": pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(times.astype(np.int64))]),
                }
            )

    columns = "doc_id long, key long, n int, node long, mark binary, token long, times long"
    return docs.select("doc_id", "text", _key()).mapInArrow(look, columns)


def frequent_shingles(surveyed, most=HOT):
    """(sorted hashes, counts) of the most frequent shingles over all documents."""
    times = surveyed.filter("n < 0").groupBy("token").agg(F.sum("times").alias("times"))
    top = times.orderBy(F.desc("times"), "token").limit(most).toPandas()
    token, n = top.token.to_numpy(np.int64).view(np.uint64), top.times.to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def ordered_prefixes(docs, hot, percent=PERCENT, n_words=WORDS):
    """(node, n, prefix, rare): the first shingles in global order, enough for every need, and how many
    of them are outside the frequent list; copies within a batch once."""
    tokens, counts = hot

    def prefix(batches):
        for batch in batches:
            sets = {_node(s): s for s in _sets(batch, n_words) if len(s)}
            heads, rares = [], []
            for s in sets.values():
                at = np.searchsorted(tokens, s)
                at[at == len(tokens)] = 0
                known = tokens[at] == s if len(tokens) else np.zeros(len(s), dtype=bool)
                late = s[known][np.argsort(counts[at[known]], kind="stable")]
                length = min(len(s), len(s) - _must(len(s), percent) + max(1, len(s) // PARTS[-1]))
                rares.append(min(length, int(len(s) - known.sum())))
                heads.append(np.concatenate([s[~known], late])[:length].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sets), pa.int64()), pa.array([len(s) for s in sets.values()], pa.int32()), _lists(heads),
                 pa.array(rares, pa.int32())],
                ["node", "n", "prefix", "rare"],
            )

    return docs.select("text").mapInArrow(prefix, "node long, n int, prefix array<bigint>, rare int")


def shared_postings(prefixes):
    """(token, node, n, pos, df) of prefix shingles with two owners or more."""
    cut = prefixes.select("node", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    place = F.col("n").cast("bigint") * (1 << 31) + F.col("pos")
    # Frequent shingles are known to be shared: their owners spread over tasks and are counted later.
    often = F.col("pos") >= F.col("rare")
    # In this order what differs between the neighbouring rows of a node, token and position, is side by
    # side, so the shuffle compresses better.
    cut = cut.select("node", "token", place.alias("place"), often.alias("often"))
    spread = F.when(F.col("often"), F.pmod("node", F.lit(SPREAD))).otherwise(-1)

    def owners(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        node, token, where, often = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((node, token))
        token, node, where, often = token[order], node[order], where[order], often[order]
        new = np.concatenate(([True], token[1:] != token[:-1]))
        once = new | np.concatenate(([True], node[1:] != node[:-1]))
        token, node, where, often, new = token[once], node[once], where[once], often[once], new[once]
        sizes = np.diff(np.append(np.flatnonzero(new), len(token)))
        df = np.where(often, 0, np.repeat(sizes, sizes))
        keep = df != 1
        table = pa.table({"token": token[keep], "node": node[keep], "place": where[keep], "df": df[keep]})
        yield from table.to_batches(max_chunksize=10_000)

    met = cut.repartition("token", spread).mapInArrow(owners, "token long, node long, place long, df long")
    met = stage(met, "owners")
    late = met.filter("df = 0").drop("df")
    counted = late.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = met.filter("df > 0").union(late.join(F.broadcast(counted), "token"))  # at most HOT rows
    return shared.select(
        "token", "node", F.expr("cast(place div 2147483648 as int)").alias("n"),
        F.expr("cast(place % 2147483648 as int)").alias("pos"), "df",
    )


def adaptive_prefixes(postings, percent=PERCENT):
    """(token, node, n, need, score): postings within the prefix of the need each node chose."""
    own = W.partitionBy("node")
    head = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)  # the prefix for need l is head + l long
    needs = dict(enumerate(_needs(F.col("n"))))
    inside = {i: F.col("pos") < head + l for i, l in needs.items()}
    met = {i: F.sum(F.when(x, F.col("df") - 1).otherwise(0)).over(own) for i, x in inside.items()}
    held = {i: F.sum(F.when(x, 1).otherwise(0)).over(own) for i, x in inside.items()}
    out = postings.withColumns({f"_c{i}": met[i] * (1 + VERIFY_COST / l) for i, l in needs.items()})
    out = out.withColumns({f"_h{i}": held[i] for i in needs}).withColumn("_owned", F.count(F.lit(1)).over(own))
    # What no partner at all shares often enough has no partner.
    for i, l in needs.items():
        out = out.filter(F.col(f"_h{i}") >= l)
    best, need = F.least(*[F.col(f"_c{i}") for i in needs]), needs[len(PARTS) - 1]
    for i in range(len(PARTS) - 2, -1, -1):
        need = F.when(F.col(f"_c{i}") == best, needs[i]).otherwise(need)
    out = out.withColumn("need", need).filter(F.col("pos") < head + F.col("need"))
    # Shingles nobody shares cannot be in an intersection: at most this many are.
    most = F.col("n") - (F.least(F.col("n"), head + needs[len(PARTS) - 1]) - F.col("_owned"))
    return out.select("token", "node", "n", most.cast("int").alias("most"), "need")


def _can_link(n, most, n2, most2, percent):
    """Whether sets of n and n2 shingles can be similar enough, sharing at most the smaller most."""
    return F.least(most, most2) * (100 + percent) >= percent * (n + n2)


def promising_pairs(prefixes, percent=PERCENT):
    """(a, b): for each node the partner it shares most with among the heads of its lists, the heads
    being the nodes with the largest share of shared shingles."""
    head = F.struct((F.col("most") / F.col("n")).alias("score"), "node", "n", "most", "need")
    heads = stage(prefixes.groupBy("token").agg(F.max(head).alias("h")), "heads")
    met = prefixes.join(heads, "token").filter(F.col("node") != F.col("h.node"))
    met = met.filter(_can_link(F.col("n"), F.col("most"), F.col("h.n"), F.col("h.most"), percent))
    met = met.groupBy("node", F.col("h.node").alias("b"), F.least("need", "h.need").alias("least"))
    met = met.agg(F.count(F.lit(1)).alias("k"), F.max("h.score").alias("s")).filter("k >= least")
    best = met.groupBy("node").agg(F.max(F.struct("k", "s", "b")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.b").alias("b"))


def node_sets(docs, pairs, nodes, n_words=WORDS, bits=FILTER_BITS):
    """(node, tokens) of the nodes in pairs (a, b), computed from one text of each.

    ``nodes`` (node, mark, key) names that text by its hash; texts whose hash has no bit in the filter
    are passed over unread.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stage(wanted.join(nodes.select("node", "key"), "node"), "wanted")
    bit = F.pmod("key", F.lit(bits)) + 1  # bucket and position both count from 1
    marks = wanted.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("marks")
    )
    filled = np.zeros(bits + (1 << 16), dtype=bool)
    for part, mark in marks.collect():  # at most bits / 32768 rows of 4096 bytes
        flags = np.unpackbits(np.frombuffer(bytes(mark), dtype=np.uint8), bitorder="little")
        start = (part - 1) * 32768
        filled[start : start + len(flags)] = flags
    filled = np.packbits(filled)

    def sets(batches):
        for batch in batches:
            at = batch.column(1).to_numpy() % bits
            batch = batch.filter(pa.array((filled[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            found = {_node(s): s.view(np.int64) for s in _sets(batch, n_words) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), _lists(list(found.values()))], ["node", "tokens"])

    found = docs.select("text", _key()).mapInArrow(sets, "node long, tokens array<bigint>")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def possible_pairs(pairs, sets, percent=PERCENT):
    """Pairs (a, b) that can be similar enough by 16 bits of each token, a quarter of what the sets take.

    A shared token is shared by its bits too; tokens of a set that have their bits in common are one
    among these, and as many more may be shared, at most.
    """
    bits = F.transform("tokens", lambda t: (F.pmod(t, F.lit(SHORT)) - SHORT // 2).cast("smallint"))
    short = sets.select("node", F.size("tokens").alias("n"), F.array_distinct(bits).alias("s"))
    both = pairs.join(short.toDF("b", "nb", "sb"), "b").join(short.toDF("a", "na", "sa"), "a")
    more = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")) + more)
    return both.filter(F.col("i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def verified(docs, pairs, nodes, percent=PERCENT, n_words=WORDS, misses=False):
    """Pairs (a, b) whose whole sets are similar enough. ``misses``: most pairs are none, so they are
    bounded before whole sets are sent."""
    sets = stage(node_sets(docs, pairs, nodes, n_words), "sets")
    if misses:
        pairs = stage(possible_pairs(pairs, sets, percent), "possible")
        met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = sets.join(met, "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(right, "b").join(left, "a")
    both = both.withColumn("i", F.size(F.array_intersect("ta", "tb")))
    return both.filter(F.col("i") * 100 >= percent * (F.size("ta") + F.size("tb") - F.col("i"))).select("a", "b")


def _runs_of_rows(sizes, most):
    """(first, last) of runs of rows whose sizes sum up to ``most``, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _flat(column):
    """(offsets, values) of a list column, values as an array; binary values as rows of 64-bit words."""
    offsets = column.offsets.to_numpy()
    values = column.flatten()  # the values of this slice only
    if pa.types.is_binary(values.type):
        values = np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint64).reshape(len(values), -1)
    else:
        values = values.to_numpy()
    return offsets - offsets[0], values


def _counted(parts):
    """Distinct pairs of (a, b, need) arrays, with how often each occurs and its least need."""
    a, b, need = (np.concatenate(x) for x in zip(*parts))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    k = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_pydict({"a": a[first], "b": b[first], "k": k, "need": np.minimum.reduceat(need, first)})


def comparer(percent, second):
    """Compares in each row the list of entries with the second list, whose columns end in ``second``:
    (a, b, k, need) of the pairs that can link, the k tokens a pair shares in a task counted there."""

    def compare(batches):
        held, size = [], 0
        for batch in batches:
            side = {}
            for x in ENTRY:
                side[x] = _flat(batch.column(batch.schema.get_field_index(x)))
                side[x, 2] = _flat(batch.column(batch.schema.get_field_index(x + second)))
            from1, from2 = side["node"][0], side["node", 2][0]
            len1, len2 = np.diff(from1), np.diff(from2)
            salt, salt2 = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("salt", "salt" + second))
            for at, to in _runs_of_rows(len1.astype(np.int64) * len2, AT_ONCE):
                # Entry i of the first list, repeated for each entry j of the second one.
                row = np.repeat(np.arange(at, to), len1[at:to])
                i = np.arange(from1[at], from1[to])
                times = len2[row]
                starts = np.cumsum(times) - times
                j = np.arange(times.sum()) + np.repeat(from2[row] - starts, times)
                i, row = np.repeat(i, times), np.repeat(row, times)
                v = {x: side[x][1] for x in ENTRY}
                w = {x: side[x, 2][1] for x in ENTRY}
                ok = np.minimum(v["most"][i], w["most"][j]) * (100 + percent) >= percent * (v["n"][i] + w["n"][j])
                ok &= v["g"][i] != w["g"][j]
                ok &= (salt[row] < salt2[row]) | (v["node"][i] < w["node"][j])
                i, j = i[ok], j[ok]
                apart = np.bitwise_count(v["mark"][i] ^ w["mark"][j]).sum(axis=1, dtype=np.int64)
                both = v["n"][i] + w["n"][j]
                ok = (both - apart) * (100 + percent) >= 2 * percent * both
                i, j = i[ok], j[ok]
                held.append((v["node"][i], w["node"][j], np.minimum(v["need"][i], w["need"][j])))
                size += len(i)
            if size > COUNTED:
                yield _counted(held)
                held, size = [], 0
        if size:
            yield _counted(held)

    return compare


def group_pairs(prefixes, groups, marks, percent=PERCENT, block=BLOCK):
    """(a, b) of different groups that share as many prefix shingles as the smaller need.

    Posting lists meet in blocks of about ``block`` entries; NumPy compares two blocks at a time and
    only pairs that can link become rows. A list of one block meets itself where it is.
    """
    placed = prefixes.join(groups, "node", "left").withColumn("g", F.coalesce("g", "node"))
    placed = placed.select("token", "node", F.col("n").cast("bigint"), F.col("most").cast("bigint"), F.col("need").cast("bigint"), "g")
    placed = stage(placed, "grouped")
    spans = placed.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    spans = stage(spans.filter("lo < hi").select("token", F.ceil(F.col("c") / block).alias("blocks")), "spans")
    salt = F.pmod(F.xxhash64("node"), "blocks").alias("salt")
    lists = placed.join(spans, "token").join(marks, "node").groupBy("token", "blocks", salt)
    # One list of structs on the way: six lists of some entries each would be mostly headers.
    lists = lists.agg(F.collect_list(F.struct(*ENTRY)).alias("e"))
    lists = stage(lists.select("token", "blocks", "salt", *[F.col("e")[x].alias(x) for x in ENTRY]), "lists")
    many = lists.filter("blocks > 1").drop("blocks")
    other = many.select("token", *[F.col(x).alias(f"{x}2") for x in ("salt", *ENTRY)])
    met = many.join(other, "token").filter("salt <= salt2").drop("token")
    alone = lists.filter("blocks = 1").select("salt", *ENTRY)
    columns = "a long, b long, k long, need long"
    met = met.mapInArrow(comparer(percent, "2"), columns).union(alone.mapInArrow(comparer(percent, ""), columns))
    met = met.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("need").alias("need"))
    return met.filter("k >= need").select("a", "b")


def _rooted(docs, percent, n_words):
    """(rows, nodes): (doc_id, key, n, node) of each document, and (node, first_id, root) of each set."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text"))
    surveyed = stage(survey(docs, n_words), "survey")
    hot = frequent_shingles(surveyed)
    postings = shared_postings(ordered_prefixes(docs, hot, percent, n_words))
    prefixes = stage(adaptive_prefixes(postings, percent), "adapted")
    rows = surveyed.filter("n >= 0")
    seen = F.min(F.struct("key", "mark"))
    nodes = rows.filter("n > 0").groupBy("node").agg(seen.alias("s"), F.min("doc_id").alias("first_id"))
    nodes = stage(nodes.select("node", "s.key", "s.mark", "first_id"), "nodes")
    promising = stage(promising_pairs(prefixes, percent), "promising")
    near = stage(verified(docs, promising, nodes, percent, n_words), "near")
    groups = components(near).withColumnRenamed("root", "g")
    pairs = stage(group_pairs(prefixes, groups, nodes.select("node", "mark"), percent), "pairs")
    roots = components(near.union(verified(docs, pairs, nodes, percent, n_words, misses=True)))
    nodes = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    return rows, stage(nodes, "rooted")


def jaccard_components(docs, percent=PERCENT, n_words=WORDS):
    """(doc_id, n_shingles, component_id) of every document."""
    rows, nodes = _rooted(docs, percent, n_words)
    least = nodes.groupBy("root").agg(F.min("first_id").alias("least_id"))
    ids = stage(nodes.join(least, "root").select("node", "least_id"), "component-ids")
    return rows.join(ids, "node", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def first_of_each(docs, percent=PERCENT, n_words=WORDS):
    """One document of each component, whole, and all documents without shingles.

    The one with the smallest id stays, null ids last; of equal ids the one whose text has the smallest
    hash. Rows equal in id and text are one document, of which the row with the smallest hash stays.
    """
    rows, nodes = _rooted(docs, percent, n_words)
    member = rows.filter("n > 0").join(nodes.select("node", "root"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    keep = member.groupBy("root").agg(first).select("f.doc_id", "f.key")
    keep = keep.union(rows.filter("n = 0").select("doc_id", "key").distinct())
    keep = stage(keep.toDF("_keep_id", "_keep_key"), "kept")
    docs, names = apart(docs, ("_id", "_key", "_nth", "_keep_id", "_keep_key"))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("bigint"), "_key": F.xxhash64(whole(F.col("text")))})
    same = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_key") == F.col("_keep_key"))
    order = W.partitionBy("_id", "_key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    kept = keyed.join(keep, same, "left_semi").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return kept.select(*docs.columns).withColumnsRenamed(names)
