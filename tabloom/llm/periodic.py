"""Periodic runs of words, found on a grammar of the word ids.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least
``min_length`` words and three periods long, and that no neighbouring word extends. A run's copies
are the words after its first q.

Per block of documents (bounded text, one long document at least), inside an Arrow task:

1. Words get exact ids. If a run holds a window of ``min_length // 3`` words, the window occurs twice
   in the document, so only stretches of windows that do can hold runs; the other words are what the
   grammar would leave as they are, and are set aside.
2. Re-Pair over all stretches of the block: the most frequent pairs become nonterminals until no pair
   occurs twice. Pairs that do not overlap are replaced in the same round (ties go to the shorter, then
   by a hash), which keeps the grammar shallow. What is left of a stretch is paired into a balanced
   tree.
3. Each nonterminal is looked at once: runs that cross the boundary of its two halves, from one of
   its occurrences. Candidates are the places where the words at the boundary occur again.
4. These are translated to all places where the nonterminal was put in, and of intervals with the same
   period only those in no other are left. A run is found whole at the smallest nonterminal around
   it; what the edge of another one cuts off lies inside it.

Defined cases: null, empty and short texts have no runs and an empty or unchanged text; blanks between
words become one space each; repeated rows get equal results; other columns pass through, and those
named like a new one are replaced by it. A document is one row, so one task holds it whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import mix, runs
from .words import beside

MIN_LENGTH = 24
BLOCK_WORDS = 500_000
RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
NEW = ("n_words", "runs", "collapsed_text")


def _equal(w, i, j, end):
    """Number of equal words of w from i and from j > i on, j staying below end."""
    n, step = 0, 64
    while j + n < end:
        size = min(step, end - j - n)
        unlike = w[i + n : i + n + size] != w[j + n : j + n + size]
        k = int(unlike.argmax())
        if unlike[k]:
            return n + k
        n, step = n + size, min(4 * step, 1 << 20)
    return n


def _ahead(w, back, gram, width, low, mid, high, least):
    """Runs (start, end, period) of w[low:high] across mid that reach 1.5 periods and least / 2 words
    beyond it. ``back`` is w reversed; equal ``gram`` stand for equal words of that width."""
    half, found = (least + 1) // 2, set()
    room = high - mid
    if room < half:
        return found
    q = np.flatnonzero(gram[mid + 1 : mid + 1 + min(room * 2 // 3, room - width)] == gram[mid]) + 1
    need = np.maximum((3 * q + 1) // 2, half) - q  # so many words repeat after the period
    q, need = q[q + need <= room], need[q + need <= room]
    for share in (1, 2):  # the last and the middle one of the windows that must repeat
        part = (need - width) // share
        same = gram[mid + part] == gram[mid + q + part]
        q, need = q[same], need[same]
    while len(q):
        period, must = int(q[0]), int(need[0])
        alike = _equal(w, mid, mid + period, mid + period + must)
        left = np.ones(len(q), dtype=bool)
        left[0] = False
        if alike == must:
            end = mid + period + must + _equal(w, mid + must, mid + period + must, high)
            last = len(w) - 1 - mid  # word mid - 1 is back[last + 1]
            start = mid - _equal(back, last + 1 - period, last + 1, len(w) - low)
            if start < mid and end - start >= max(least, 3 * period):
                found.add((start, end, period))
                left &= (q % period != 0) | (mid + q >= end)  # multiples give the same stretch
        q, need = q[left], need[left]
    return found


class Words:
    """Ids of the words to look at, with what comparing their windows takes."""

    def __init__(self, ids, least):
        self.ids, self.least, self.width = ids, least, max(1, least // 6)
        self.back = ids[::-1]
        gram, size = ids, 1
        while size < self.width:  # ranks of windows, wider by one word at a time
            pair = gram[:-1].astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids[size:]
            gram, size = np.unique(pair, return_inverse=True)[1], size + 1
        self.gram, self.gram_back = gram, gram[::-1]

    def crossing(self, low, mid, high):
        """Runs of the words from low to high that hold both mid - 1 and mid, as (start, end, period)."""
        if high - low < self.least:
            return ()
        n = len(self.ids)
        found = _ahead(self.ids, self.back, self.gram, self.width, low, mid, high, self.least)
        mirrored = _ahead(self.back, self.ids, self.gram_back, self.width, n - high, n - mid, n - low, self.least)
        return found | {(n - e, n - s, q) for s, e, q in mirrored}


def _chosen(rank):
    """Places of pairs to replace: ranked before both neighbours; every second one of equal neighbours."""
    far = np.iinfo(np.int64).max
    before = np.concatenate(([far], rank[:-1]))
    after = np.concatenate((rank[1:], [far]))
    at = np.arange(len(rank))
    first = np.maximum.accumulate(np.where(rank != before, at, 0))
    offset = at - first - (rank[first] > before[first])
    return (rank < far) & (offset >= 0) & (offset % 2 == 0) & (rank <= after)


def re_pair(ids, cuts):
    """Yields (starts, size of the left half, size) of each nonterminal of stretches that lie between
    cuts, the last halves of what is left included."""
    symbol = ids.astype(np.int64)
    place, size = np.arange(len(ids)), np.ones(len(ids), dtype=np.int64)
    border = np.zeros(len(ids) + 1, dtype=bool)
    border[cuts] = True
    base, far = int(symbol.max(initial=0)) + 1, np.iinfo(np.int64).max
    while len(symbol) > 1:
        inside = ~border[place[1:]]
        key = np.where(inside, symbol[:-1] * base + symbol[1:], -1)
        pair, kind = np.unique(key, return_inverse=True)
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
        times = np.bincount(kind[(at - first) % 2 == 0], minlength=len(pair))
        often = (times >= 2) & (pair >= 0)
        if not often.any():
            break
        some = np.zeros(len(pair), dtype=np.int64)
        some[kind] = at
        weight = size[some] + size[some + 1]
        order = np.lexsort((mix(pair.view(np.uint64)), weight, -times))
        rank = np.empty(len(pair), dtype=np.int64)
        rank[order] = np.arange(len(pair))
        rank[~often] = far
        taken = _chosen(rank[kind])
        again = np.bincount(kind[taken], minlength=len(pair)) >= 2
        taken &= again[kind]
        i = np.flatnonzero(taken)
        by = i[np.argsort(kind[i], kind="stable")]
        for group in np.split(by, np.flatnonzero(np.diff(kind[by])) + 1):
            g = group[0]
            yield place[group], int(size[g]), int(size[g] + size[g + 1])
        names = np.cumsum(again) - 1 + base
        base += int(again.sum())
        symbol[i] = names[kind[i]]
        size[i] += size[i + 1]
        left = np.ones(len(symbol), dtype=bool)
        left[i + 1] = False
        symbol, place, size = symbol[left], place[left], size[left]
    while len(place) > 1:  # neighbours of a stretch, pair by pair
        start = np.flatnonzero(border[place])
        first = np.repeat(start, np.diff(np.append(start, len(place))))
        odd = (np.arange(len(place)) - first) % 2 == 1
        i = np.flatnonzero(odd) - 1
        if not len(i):
            break
        for p, a, b in zip(place[i], size[i], size[i + 1]):
            yield np.array([p]), int(a), int(a + b)
        size[i] += size[i + 1]
        place, size = place[~odd], size[~odd]


def grammar_runs(ids, cuts, least=MIN_LENGTH):
    """(start, end, period) arrays of the maximal runs of stretches of word ids between cuts."""
    words, found = Words(ids, least), []
    for places, left, size in re_pair(ids, cuts):
        if size >= least:
            p = int(places[0])
            for s, e, q in words.crossing(p, p + left, p + size):
                found.append((places + (s - p), places + (e - p), np.full(len(places), q)))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    # Of one period, an interval within one that starts no later is a part of it.
    reach = np.maximum.accumulate(end + period * (len(ids) + 1))
    new = np.concatenate(([True], end[1:] + period[1:] * (len(ids) + 1) > reach[:-1]))
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def stretches(ids, least=MIN_LENGTH):
    """(first, end) of the stretches of a document's word ids that can hold runs."""
    width = least // 3
    if len(ids) < least:
        return []
    window = runs(mix(ids.astype(np.uint64)), width)
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(len(window) + 2, dtype=np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edge = np.diff(again)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + width - 1
    long = end - first >= least
    return list(zip(first[long].tolist(), end[long].tolist()))


def block_runs(documents, least=MIN_LENGTH):
    """Runs [(start, length, period), ...] of each document, a list of words, of a block."""
    names, parts, owners, cuts, at = {}, [], [], [], 0
    for k, words in enumerate(documents):
        if len(words) < least:
            continue
        own = dict.fromkeys(words)
        own = dict(zip(own, range(len(own))))
        for first, end in stretches(np.fromiter(map(own.__getitem__, words), np.int64, len(words)), least):
            parts.append([names.setdefault(w, len(names)) for w in words[first:end]])
            owners.append((k, first))
            cuts.append(at)
            at += end - first
    out = [[] for _ in documents]
    if parts:
        ids = np.concatenate(parts)
        start, end, period = grammar_runs(ids, np.array(cuts), least)
        stretch = np.searchsorted(cuts, start, side="right") - 1
        for s, e, q, i in zip(start.tolist(), end.tolist(), period.tolist(), stretch.tolist()):
            k, first = owners[i]
            out[k].append((first + s - cuts[i], e - s, q))
    return out


def collapsed(words, found):
    """The words outside the copies of the runs."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def find_runs(docs, least=MIN_LENGTH, prepare=None, key="doc_id"):
    """docs with n_words, runs (by start, then period) and collapsed_text, text left out.

    ``prepare(id, words)`` may change a document's words, bytes in a list, before the search.
    """
    if least < 6:
        raise ValueError("runs of fewer than six words are not searched for")
    kept = [c for c in docs.columns if c != "text" and c not in NEW]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed_text", T.StringType())]
    )
    arrow_runs = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def search(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            ids = batch.column(batch.num_columns - 2)
            at = 0
            while at < len(batch):
                first, words, size = at, [], 0
                while at < len(batch) and (size < BLOCK_WORDS or not words):
                    own = (texts[at].as_py() or "").encode("utf-8", "surrogatepass").split()
                    words.append(prepare(ids[at].as_py(), own) if prepare else own)
                    size += len(own)
                    at += 1
                found = block_runs(words, least)
                left = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, found)]
                listed = [[dict(zip(("start", "length", "period"), x)) for x in r] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, at - first) for i in range(len(kept))),
                     pa.array([len(w) for w in words], pa.int64()), pa.array(listed, arrow_runs), pa.array(left, pa.string())],
                    [*kept, "n_words", "runs", "collapsed_text"],
                )

    return beside(docs, kept, F.col(key), F.col("text").cast("string")).mapInArrow(search, schema)
