"""Benchmark decontamination: a broadcast hash set of test n-grams against all training windows.

Each item gives its windows of ``n`` words (an item of fewer words is one window). Windows of a
document are hashed and looked up; a hit counts once a second hash of the same words agrees. The
words under hits are marked, and documents or spans go.

The set is broadcast while it holds at most ``max_broadcast`` windows (counted beforehand); a larger
one is joined by key instead, with the same rows. Up to ``max_listed`` windows, runs whose first and
last word belong to no window are left out before they are hashed; that only saves work.

Defined cases: null texts have no words; items with a null id mark words but are not listed; equal
windows count for each item; equal rows get equal results; no items, no hits; a very long text is one
row and is read whole. ``mark_documents`` passes other columns through and replaces those named like a
new one; the others give back the columns they got.
"""

from pyspark.sql import functions as F

from .words import PLAIN_GAP, apart, plain_words, same_row, text_key, whole

N = 10
MAX_BROADCAST = 2_000_000  # windows of some 60 bytes
MAX_LISTED = 100_000  # windows whose ends are listed in the expression


def _hashed(words, start, width):
    """(start, window_hash, check) of the run of ``width`` words at 1-based ``start``."""
    run = F.slice(words, start, width)
    return F.struct(
        (start - 1).alias("start"),
        F.xxhash64(run).alias("window_hash"),
        F.xxhash64(F.lit("second"), run).alias("check"),
    )


def _ends(words, start, width):
    """Hash of the first and last word of a run."""
    return F.xxhash64(F.get(words, start - 1), F.get(words, start + width - 2))


def _runs(words, width, ends=None):
    """Hashed runs of ``width`` words; with ``ends``, only those whose first and last word are listed."""
    last = F.size(words) - width + 1
    starts = F.sequence(F.lit(1), last)
    if ends is not None:
        starts = F.filter(starts, lambda i: _ends(words, i, width).isin(ends))
    return F.when(last > 0, F.transform(starts, lambda i: _hashed(words, i, width)))


def item_windows(items, n=N):
    """(window_hash, check, width, ends, items) for each distinct window of the test items."""
    cut = items.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("w"))
    cut = cut.withColumn("width", F.least(F.size("w"), F.lit(n))).filter("width > 0")
    last = F.size("w") - F.col("width") + 1
    runs = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.struct(_hashed(F.col("w"), i, F.col("width")).alias("run"), _ends(F.col("w"), i, F.col("width")).alias("ends")),
    )
    runs = cut.select("item", "width", F.inline(runs)).select("item", "width", "run.*", "ends")
    return runs.groupBy("window_hash", "check", "width", "ends").agg(F.collect_set("item").alias("items"))


def find_hits(docs, items, n=N, max_broadcast=MAX_BROADCAST, max_listed=MAX_LISTED):
    """(doc_id, text_key, start, width, items): each place of a document where a window occurs."""
    windows = item_windows(items, n).withColumnsRenamed({"window_hash": "_hash", "check": "_check", "width": "_width"})
    widths = {r[0]: r[1] for r in windows.groupBy("_width").count().collect()}  # at most n rows
    fits = sum(widths.values()) <= max_broadcast
    cut = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), plain_words(F.col("text")).alias("w"))
    hits = []
    for width in sorted(widths) or [n]:
        some = windows.filter(F.col("_width") == width)
        ends = None
        if 0 < widths.get(width, 0) <= max_listed:
            ends = [r[0] for r in some.select("ends").distinct().collect()]
        placed = cut.select("doc_id", "text_key", F.inline(_runs(F.col("w"), F.lit(width), ends)))
        same = (placed["window_hash"] == some["_hash"]) & (placed["check"] == some["_check"])
        found = placed.join(F.broadcast(some) if fits else some, same)
        hits.append(found.select("doc_id", "text_key", "start", F.lit(width).alias("width"), "items"))
    out = hits[0]
    for more in hits[1:]:
        out = out.union(more)
    return out


def hit_documents(docs, items, n=N, max_broadcast=MAX_BROADCAST, max_listed=MAX_LISTED):
    """(doc_id, text_key, n_hit, n_items, hit_items, spans) of each text with a hit.

    hit_items: distinct item ids, sorted as strings; spans: sorted distinct (start, width) in words.
    """
    found = find_hits(docs, items, n, max_broadcast, max_listed).groupBy("doc_id", "text_key")
    found = found.agg(
        F.array_sort(F.collect_set(F.struct("start", "width"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"),
    )
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.width - 1)))
    return found.withColumns(
        {
            "n_hit": F.size(F.array_distinct(places)).cast("bigint"),
            "n_items": F.size("hit_items").cast("bigint"),
        }
    )


def mark_documents(docs, items, n=N, max_broadcast=MAX_BROADCAST, max_listed=MAX_LISTED):
    """docs with n_words, n_hit, n_items, hit_items, spans and contaminated."""
    new = ["n_words", "n_hit", "n_items", "hit_items", "spans", "contaminated"]
    docs, names = apart(docs.drop(*new), ["text_key"])
    rows = docs.withColumns(
        {
            "text_key": text_key(F.col("text")),
            "n_words": F.regexp_count(whole(F.col("text")), F.lit(PLAIN_GAP.replace("[", "[^", 1))).cast("bigint"),
        }
    )
    found = hit_documents(docs, items, n, max_broadcast, max_listed)
    out = rows.join(found, same_row(rows, found), "left")
    kept = [rows[c] for c in rows.columns if c != "text_key"]
    return out.select(
        *kept,
        F.coalesce(found["n_hit"], F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(found["n_items"], F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(found["hit_items"], F.array().cast("array<string>")).alias("hit_items"),
        found["spans"],
        found["n_hit"].isNotNull().alias("contaminated"),
    ).withColumnsRenamed(names)


def drop_contaminated(docs, items, n=N, max_broadcast=MAX_BROADCAST, max_listed=MAX_LISTED):
    """Documents without a hit, as they are."""
    docs, names = apart(docs, ["text_key"])
    keyed = docs.select("*", text_key(F.col("text")).alias("text_key"))
    found = hit_documents(docs, items, n, max_broadcast, max_listed)
    return keyed.join(found, same_row(keyed, found), "left_anti").select(*docs.columns).withColumnsRenamed(names)


def cut_spans(docs, items, n=N, max_broadcast=MAX_BROADCAST, max_listed=MAX_LISTED):
    """All documents, the words under hits taken out with the gap after each."""
    work = ("n_words", "n_hit", "n_items", "hit_items", "spans", "contaminated", "text_key", "_cut", "_pieces")
    docs, names = apart(docs, work)
    marked = mark_documents(docs, items, n, max_broadcast, max_listed)
    word = PLAIN_GAP.replace("[", "[^", 1)
    # Pieces: a word and the gap behind it; what stands before the first word stays in front.
    head = F.regexp_extract("text", "^" + PLAIN_GAP.replace("+", "*"), 0)
    pieces = F.regexp_extract_all("text", F.lit(f"{word}{PLAIN_GAP.replace('+', '*')}"), F.lit(0))
    places = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.width - 1)))
    )
    out = marked.withColumn("_cut", places).withColumn("_pieces", pieces)
    # One pass by position: array_except keeps what is not under a hit.
    left = F.array_except(F.sequence(F.lit(0), F.size("_pieces") - 1), F.col("_cut"))
    text = F.concat(head, F.array_join(F.transform(left, lambda i: F.get(F.col("_pieces"), i)), ""))
    text = F.when(F.col("contaminated"), text).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns]).withColumnsRenamed(names)
