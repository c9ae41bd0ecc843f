"""SentencePiece encoding and decoding through tables of distinct marked words.

The model marks each space, and puts one mark before the text. No piece of the vocabulary has
a mark behind another character or holds a line end, so no merge crosses the place before a run of marks
or before a line end: what lies between two such places, a chunk, has the same ids in every text. Both
properties are read off the vocabulary, and marked texts are compared with the library when a model
is opened; a model without them is refused.

Per block of documents (bounded text, one long document at least), inside an Arrow task: texts are cut
into chunks by Arrow, chunks become codes into the table of the block's distinct chunks, each
distinct chunk is segmented once by the library, and ids are joined back by position. Ids are decoded
by the library's ``decode``.

There is a table per block, none for the corpus: a corpus-wide one would have to send every
distinct chunk of each task, and its ids back, through shuffles, against segmenting a chunk again in
another block.

Defined cases: a null text is the empty text, without ids; texts with a NUL character are encoded whole;
blanks of any kind, marks in the text and characters outside the vocabulary are as the library has them;
repeated rows get equal results; other columns pass through, and those named like a new one are
replaced by it. A document is one row, so one task holds it whole.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import beside, whole

MARK, NUL = "▁", "\0"
BLOCK_BYTES = 8_000_000
NEW = ("n_tokens", "ids", "decoded")
PROBES = ("", " ", "a", "  two  marks ", "line\nend \n\n of\n", f"{MARK} {MARK}x", "é中\U0001f600\t\r", "<s></s><unk><0x41>")


def chunks_of(texts):
    """Arrow list of the chunks of each text (large_string, no nulls, no NUL): a run of spaces or one line
    end, and what follows up to the next; the mark before the text is a space here."""
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    marked = pc.binary_join_element_wise(space, pc.replace_substring(texts, MARK, " "), none)
    parted = pc.replace_substring_regex(marked, "( +|\n)", NUL + r"\1")
    parted = pc.if_else(pc.equal(texts, none), none, pc.replace_substring(parted, NUL, "", max_replacements=1))
    return pc.split_pattern(parted, NUL)


class Pieces:
    """A model and what cutting texts at marks and line ends needs to know of it."""

    def __init__(self, model):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=model)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError(f"pieces of {model} cross marks or line ends")
        self.mark = library.piece_to_id(MARK)
        texts = [*PROBES, "".join(PROBES)]
        if [x.tolist() for x in self.encode(texts)] != [library.encode(t) for t in texts]:
            raise ValueError(f"{model} does not mark texts by one space in front and one mark a space")

    def segment(self, chunks):
        """Ids of each chunk: the library puts the leading mark back itself."""
        spaced = [c[1:] if c[0] == " " else c for c in chunks]
        found = self.library.encode(spaced, num_threads=1)
        # A line end does not merge with the mark the library puts before it; nothing but a mark is a mark.
        return [x[1:] if c[0] == "\n" else x or [self.mark] for c, x in zip(chunks, found)]

    def encode(self, texts):
        """Ids of each text of a list or an Arrow array without nulls, as integer arrays."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        odd = pc.match_substring(texts, NUL)
        lists = chunks_of(pc.if_else(odd, pa.scalar("", pa.large_string()), texts))
        ends = lists.offsets.to_numpy()
        table = lists.flatten().dictionary_encode()
        code, chunks = table.indices.to_numpy(), table.dictionary.to_numpy(zero_copy_only=False).tolist()
        full = np.array([c != "" for c in chunks], dtype=bool)  # an empty text has one empty chunk
        ids = [[]] * len(chunks)
        for i, x in zip(np.flatnonzero(full).tolist(), self.segment([c for c in chunks if c])):
            ids[i] = x
        size = np.array([len(x) for x in ids], dtype=np.int64)
        first = np.cumsum(size) - size
        flat = np.array([i for x in ids for i in x], dtype=np.int32)
        # Id k of a chunk's place comes from id k of its entry.
        sizes = size[code]
        before = np.concatenate(([0], np.cumsum(sizes)))
        joined = flat[np.arange(before[-1]) + np.repeat(first[code] - before[:-1], sizes)]
        cuts = before[ends - ends[0]]
        out = [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.library.encode(texts[i].as_py()), dtype=np.int32)
        return out

    def decode(self, ids):
        """The library's text of each array of ids."""
        return [self.library.decode(x.tolist()) if len(x) else "" for x in ids]


@lru_cache(maxsize=2)
def pieces(model):
    return Pieces(model)


def encode_pieces(docs, model):
    """docs with n_tokens, ids and decoded in place of text."""
    kept = [c for c in docs.columns if c != "text" and c not in NEW]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )

    def encode(batches):
        opened = pieces(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                ids = opened.encode(texts.slice(at, to - at))
                cuts = np.cumsum([0, *map(len, ids)])
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, to - at) for i in range(len(kept))),
                     pa.array(np.diff(cuts), pa.int64()), listed, pa.array(opened.decode(ids), pa.string())],
                    [*kept, "n_tokens", "ids", "decoded"],
                )
                at = to

    return beside(docs, kept, whole(F.col("text").cast("string"))).mapInArrow(encode, schema)
