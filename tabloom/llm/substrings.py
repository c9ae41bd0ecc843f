"""Substring deduplication: suffix automata of reference shards and matching statistics.

A word goes if it lies in a run of ``width`` words that also starts in a document with a smaller id.

Sending the automaton of every reference shard to every document would read the table once per
shard. Here each window of ``width`` words names its shard instead: the smallest hash among its runs
of ``anchor`` words, which equal windows share. Steps:

1. NumPy finds each document's anchors and the stretch of windows each serves; anchors of one
   document only are dropped.
2. Stretches under shared anchors are cut from the texts. Equal stretches are one reference with the
   smallest id that holds them, so copies cost one entry.
3. Stretches are dealt out by anchor. Tasks build the suffix automaton of one bounded shard after the
   other, states carrying the smallest id of a text they end in, and stream the stretches through it:
   where at least ``width`` words match, the state of the last ``width`` gives the smallest id.
   An anchor with more than ``BUSY`` different stretches is dealt out window by window.
4. Matched windows return to their documents, where overlapping ones merge into maximal spans.

Words are compared as they are; hashes only route. Defined cases: null and short texts lose
nothing; rows with a null id neither lose words nor count as references; repeated rows do not remove
each other; equal rows get equal results; an empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources.shared import stage
from .shingles import runs, words
from .words import text_key, whole

WIDTH = 50
ANCHOR = 16
BUSY = 500
SHARD_WORDS = 60_000


class SuffixAutomaton:
    """Generalised suffix automaton over words; states know the smallest id they end in."""

    def __init__(self):
        self.next, self.link, self.length, self.least = [{}], [-1], [0], [None]

    def _state(self, length, link, moves, least):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, at, word, to):
        """A copy of ``to`` for the shorter of its runs, those that end a step from ``at``."""
        copy = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]), None)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, text, doc_id):
        """Insert a list of words that document doc_id holds."""
        last = 0
        for word in text:
            to = self.next[last].get(word)
            if to is not None:
                if self.length[to] != self.length[last] + 1:
                    to = self._split(last, word, to)
                last = to
            else:
                new = self._state(self.length[last] + 1, 0, {}, None)
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    to = self.next[at][word]
                    self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
                last = new
            if self.least[last] is None or doc_id < self.least[last]:
                self.least[last] = doc_id

    def settle(self):
        """Pass smallest ids on to suffixes, longest states first."""
        for at in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, least = self.link[at], self.least[at]
            if up > 0 and (self.least[up] is None or least < self.least[up]):
                self.least[up] = least

    def matches(self, text, width):
        """Smallest id holding the width words that start at each place; None where nothing matches."""
        out, at, matched = [], 0, 0
        for i, word in enumerate(text):
            while at and word not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                matched += 1
            while at and self.length[self.link[at]] >= width:
                at = self.link[at]
                matched = self.length[at]
            if i >= width - 1:
                out.append(self.least[at] if matched >= width else None)
        return out


def find_anchors(docs, width=WIDTH, anchor=ANCHOR):
    """(doc_id, text_key, found) with found the (anchor, first, count) of each stretch of windows."""
    reach = width - anchor + 1

    def find(batches):
        for batch in batches:
            sizes, parts = [0], []
            for text in batch.column(2):
                hashes = words(text.as_py())[3]
                count = len(hashes) - width + 1
                if count < 1:
                    sizes.append(sizes[-1])
                    continue
                grams = runs(hashes, anchor)
                view = np.lib.stride_tricks.sliding_window_view(grams, reach)
                at = np.concatenate([view[i : i + 65536].argmin(axis=1) for i in range(0, count, 65536)])
                at += np.arange(count)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                parts.append((grams[at[first]].view(np.int64), first, np.diff(np.append(first, count))))
                sizes.append(sizes[-1] + len(first))
            none = (np.zeros(0, np.int64),) * 3
            a, f, c = (np.concatenate(x) for x in zip(none, *parts))
            found = pa.StructArray.from_arrays(
                [pa.array(a), pa.array(f.astype(np.int32)), pa.array(c.astype(np.int32))], ["anchor", "first", "count"]
            )
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "text_key", "found"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(
        find, "doc_id long, text_key long, found array<struct<anchor:bigint,first:int,count:int>>"
    )


def cut_stretches(docs, found, width=WIDTH):
    """(doc_id, text_key, anchor, first, stretch): the words under each shared anchor's windows."""
    some = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "found")
    both = docs.join(some, (docs["doc_id"] == F.col("_id")) & (docs["text_key"] == F.col("_key")))

    def cut(batches):
        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass").split()
                rows = batch.column(3)[i].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64()),
                        "text_key": pa.array([batch.column(1)[i].as_py()] * len(rows), pa.int64()),
                        "anchor": pa.array([r["anchor"] for r in rows], pa.int64()),
                        "first": pa.array([r["first"] for r in rows], pa.int32()),
                        "stretch": pa.array([b" ".join(text[r["first"] : r["first"] + r["count"] + width - 1]) for r in rows], pa.binary()),
                    }
                )

    # Repeated rows cut the same stretches; one is enough.
    both = both.select("doc_id", "text_key", "text", "found")
    return both.mapInArrow(cut, "doc_id long, text_key long, anchor long, first int, stretch binary")


def match_shards(references, width=WIDTH, shard_words=SHARD_WORDS):
    """(key, least) of references (anchor, key, stretch, first_id): for each window of a stretch, the
    smallest id of a document that holds it."""

    def shard(rows):
        automaton = SuffixAutomaton()
        cut = [(key, text.split(), doc_id) for key, text, doc_id in rows]
        for _, text, doc_id in cut:
            automaton.add(text, doc_id)
        automaton.settle()
        return pa.RecordBatch.from_pydict(
            {
                "key": pa.array([key for key, _, _ in cut], pa.string()),
                "least": pa.array([automaton.matches(text, width) for _, text, _ in cut], pa.list_(pa.int64())),
            }
        )

    def match(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for anchor, key, text, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_words and anchor != last:
                    yield shard(held)
                    held, size = [], 0
                held.append((key, text, doc_id))
                size += text.count(b" ") + 1
                last = anchor
        if held:
            yield shard(held)

    dealt = references.select("anchor", "key", "stretch", "first_id").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(match, "key string, least array<bigint>")


def single_windows(references, width=WIDTH):
    """(key, place, window) of each window of the stretches."""

    def cut(batches):
        for batch in batches:
            for key, stretch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = stretch.split()
                windows = [b" ".join(text[i : i + width]) for i in range(len(text) - width + 1)]
                yield pa.RecordBatch.from_pydict(
                    {"key": [key] * len(windows), "place": pa.array(range(len(windows)), pa.int32()), "window": pa.array(windows, pa.binary())}
                )

    return references.select("key", "stretch").mapInArrow(cut, "key string, place int, window binary")


def repeated_windows(docs, width=WIDTH, anchor=ANCHOR, busy=BUSY):
    """(doc_id, text_key, starts): windows of each document that a smaller id holds too."""
    docs = docs.filter("doc_id is not null")
    found = stage(find_anchors(docs, width, anchor), "anchors")
    each = found.select("doc_id", "text_key", F.inline("found"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = stage(shared.filter("lo < hi").select("anchor"), "shared-anchors")
    kept = each.join(shared, "anchor").groupBy("doc_id", "text_key")
    kept = kept.agg(F.collect_set(F.struct("anchor", "first", "count")).alias("found"))
    cut = cut_stretches(docs, kept, width).withColumn("key", F.md5("stretch"))
    cut = stage(cut, "stretches")
    references = cut.groupBy("anchor", "key", "stretch").agg(F.min("doc_id").alias("first_id"))
    references = stage(references, "references")
    crowded = references.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > busy)
    crowded = stage(crowded.select("anchor"), "busy-anchors")
    apart = stage(references.join(crowded, "anchor", "left_semi"), "busy-references")
    windows = single_windows(apart, width).join(apart.select("key", "first_id"), "key")
    windows = stage(windows.withColumn("window_key", F.md5("window")), "busy-windows")
    alone = windows.groupBy("window_key", "window").agg(F.min("first_id").alias("first_id"))
    alone = alone.select(
        F.xxhash64("window_key").alias("anchor"), F.concat(F.lit("w"), "window_key").alias("key"),
        F.col("window").alias("stretch"), "first_id",
    )
    calm = references.join(crowded, "anchor", "left_anti").select("anchor", "key", "stretch", "first_id")
    least = stage(match_shards(calm.union(alone), width), "least-ids")
    joined = windows.select("key", "place", F.concat(F.lit("w"), "window_key").alias("w"))
    joined = joined.join(least.select(F.col("key").alias("w"), F.col("least")[0].alias("m")), "w")
    joined = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("x"))
    least = stage(least.union(joined.select("key", F.transform("x", lambda x: x.m).alias("least"))), "least-of-stretch")
    places = cut.select("doc_id", "text_key", "first", "key").distinct().join(least, "key")
    starts = F.filter(
        F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull()
    )
    places = places.select("doc_id", "text_key", starts.alias("starts")).filter(F.size("starts") > 0)
    return places.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def spans(starts, width=WIDTH):
    """Maximal (start, end) of overlapping or touching windows, from their starts."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return [(int(p[0]), int(p[-1]) + width) for p in np.split(starts, cut)]


def remove_repeats(docs, width=WIDTH, anchor=ANCHOR, busy=BUSY):
    """(doc_id, n_words, n_removed, removed, kept_text) with removed the (start, end) of each span."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text"))
    docs = docs.withColumn("text_key", text_key(F.col("text")))
    found = stage(repeated_windows(docs, width, anchor, busy), "repeated-windows")
    found = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    both = docs.join(found, (docs["doc_id"] == F.col("_id")) & (docs["text_key"] == F.col("_key")), "left")

    def remove(batches):
        for batch in batches:
            rows = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "removed": [], "kept_text": []}
            for text, starts in zip(batch.column(1), batch.column(2)):
                text = text.as_py().encode("utf-8", "surrogatepass").split()
                gone = spans(np.array(starts.as_py() or [], dtype=np.int64), width)
                left, at = [], 0
                for a, b in gone:
                    left += text[at:a]
                    at = b
                left += text[at:]
                rows["n_words"].append(len(text))
                rows["n_removed"].append(len(text) - len(left))
                rows["removed"].append([{"start": a, "end": b} for a, b in gone])
                rows["kept_text"].append(b" ".join(left).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()),
                 pa.array(rows["removed"], kind), pa.array(rows["kept_text"], pa.string())], list(rows)
            )

    return both.select("doc_id", "text", "starts").mapInArrow(
        remove, "doc_id long, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept_text string"
    )
