"""Word and shingle hashes of whole texts, with NumPy inside tasks.

A word is a run of bytes other than the ASCII blanks. Its hash is a polynomial of its bytes modulo
2^64, mixed with its length; runs of words combine the hashes of their words by position.
"""

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 20
PIECE, TOGETHER = 1 << 16, 1 << 20  # bytes summed at once, and of short texts handled at once
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {}


def powers(n):
    """Powers of the base and of its inverse up to n, kept between calls."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x):
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(data):
    """Starts, ends and hashes of the words of one block of bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[data], [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix(value ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def words(text, lower=False):
    """(bytes, starts, ends, hashes) of the words of a text, None read as empty."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    read = LOWER[data] if lower else data
    if len(data) <= BLOCK:
        return (data, *_block(read))
    parts, at = [], 0
    while at < len(read):
        end = min(len(read), at + BLOCK)
        while end < len(read) and not BLANK[read[end]]:  # never cut a word
            end += 1
        starts, ends, hashes = _block(read[at:end])
        parts.append((starts + at, ends + at, hashes))
        at = end
    return (data, *(np.concatenate(x) for x in zip(*parts)))


def runs(hashes, n):
    """Hash of each run of n consecutive words; none if there are fewer."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    factor = np.uint64(n)
    for i in range(n):
        factor = mix(np.array([factor + np.uint64(i + 1)], dtype=np.uint64))[0] | np.uint64(1)
        out += hashes[i : i + count] * factor
    return mix(out)


def shingle_set(text, n=5):
    """Sorted distinct hashes of the n-word runs of a text in lower case (A-Z); fewer words are one run."""
    hashes = words(text, lower=True)[3]
    return np.unique(runs(hashes, min(n, max(1, len(hashes)))))


def _word_hashes(data, cuts):
    """(hashes, first): hashes of all words of texts lying side by side, text i's from first[i] on."""
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = BLANK[data]
    begin, end = ~blank[1:-1], ~blank[1:-1]
    begin &= blank[:-2]
    end &= blank[2:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]  # a text's edge parts words as a blank does
    begin[inner] = ~blank[inner + 1]
    end[inner - 1] = ~blank[inner]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        a, b = starts[at:to] - low, ends[at:to] - low
        piece = LOWER[data[low : low + b[-1]]]
        up, down = powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        value = (sums[b] - sums[a]) * down[a]
        hashes[at:to] = mix(value ^ ((b - a).astype(np.uint64) << np.uint64(48)))
        at = to
    return hashes, np.searchsorted(starts, cuts)


def shingle_sets(texts, n=5):
    """``shingle_set`` of each text of an Arrow array, read from its buffer."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    cuts = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else []
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    sets, at = [], 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + TOGETHER, side="right")) - 1)
        hashes, first = _word_hashes(data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
        joined = runs(hashes, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            found = np.sort(joined[a : b - n + 1] if b - a >= n else runs(hashes[a:b], max(1, b - a)))
            new = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            sets.append(found[new])
        at = to
    return sets
