"""Token-ID files: each document compressed on its own with one shared zstandard dictionary.

``write_tokens`` sorts documents by id over ranges of ids, encodes them and writes one shard file
per range: a header naming the dictionary's SHA-256, then one zstandard frame per document. Next to
it lies an index (doc_id, offset, length, n_tokens), so one short document is read by one small
range request. ``read_tokens`` reads everything back, ``read_document`` one document.

The dictionary is trained on the serialized ids of at most ``SAMPLE_DOCS`` documents of at most
``SAMPLE_BYTES`` bytes of text (a seeded draw over the whole table): it changes sizes, never
contents. With too few samples there is none, and its hash is zero.

Encoding is by the tokenizers library. Texts are cut into pieces only where the pre-tokenizer cuts as
well, so a piece is encoded once and then taken from a bounded cache of the worker.

Defined cases: a null text is the empty text, one end id; null ids come first; equal ids are ordered
by their text's hash and each keeps its own entry; an empty table writes no shard; extra columns are
ignored. Lost tasks write the same bytes again under the same name.
"""

import hashlib
import json
import sys
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, stage
from .files import Written, read_file, store, write_file
from .words import whole

MAGIC = b"TOKZ1\n"
END_ID = 0
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 8_192, 32_768
LEVEL = 3
CACHED_PIECES = 1_000_000  # of some 200 bytes
CHUNK_BYTES = 4_000_000
NO_DICTIONARY = bytes(32)
NUL = "\0"
UNEVEN = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{2}"


class Encoder:
    """Texts to little-endian unsigned 32-bit ids with the end id appended."""

    def __init__(self, vocabulary):
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise OSError("ids are serialized as this machine's unsigned 32-bit integers")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known = {}
        # Cuts hold for the byte-level pre-tokenizer; with another one texts are encoded whole.
        with open(vocabulary, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        plain = made.get("normalizer") is None and before.get("type") == "ByteLevel"
        self.cuts = plain and before.get("use_regex", True) and not before.get("add_prefix_space")

    def ids(self, texts):
        """Serialized ids of each text as the library gives them."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]  # little-endian machines only, as checked above

    def encode(self, texts):
        """Serialized ids of each text of a list or Arrow array without nulls."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        # Special tokens of the vocabulary are matched before the pre-tokenizer cuts.
        odd = pc.or_(pc.match_substring(texts, NUL), pc.match_substring_regex(texts, UNEVEN))
        odd = pc.or_(odd, pc.match_substring(texts, "<|")) if self.cuts else pc.is_valid(texts)
        lists = self._pieces(pc.if_else(odd, pa.scalar("", pa.large_string()), texts))
        ends = lists.offsets.to_numpy()
        table = lists.flatten().dictionary_encode()
        pieces = self._of(table.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(x) // 4 for x in pieces], dtype=np.int64)
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(pieces), dtype="<u4")
        code = table.indices.to_numpy()
        sizes = size[code]
        before = np.concatenate(([0], np.cumsum(sizes)))
        joined = flat[np.arange(before[-1]) + np.repeat(first[code] - before[:-1], sizes)]
        cuts = before[ends - ends[0]].tolist()
        end = np.array([END_ID], dtype="<u4").tobytes()
        out = [joined[a:b].tobytes() + end for a, b in zip(cuts[:-1], cuts[1:])]
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, x in zip(odd, self.ids([texts[i].as_py() for i in odd]) if odd else ()):
            out[i] = x + end
        return out

    def _of(self, pieces):
        """Serialized ids of distinct pieces, those known from a bounded table of the worker."""
        found = list(map(self.known.get, pieces))
        new = [p for p, x in zip(pieces, found) if x is None]
        made = dict(zip(new, self.ids(new)))
        self.known.update(made)
        if len(self.known) > CACHED_PIECES:  # the older half goes
            for p in list(islice(self.known, len(self.known) - CACHED_PIECES // 2)):
                del self.known[p]
        return [made[p] if x is None else x for p, x in zip(pieces, found)]

    @staticmethod
    def _pieces(texts):
        """Without neighbouring blanks, each space starts a token, each line end is one, and a mark
        between a letter or digit and a blank starts one."""
        parted = pc.replace_substring_regex(texts, r"([\pL\pN])([.,])([ \n])", rf"\1{NUL}\2\3")
        parted = pc.replace_substring(pc.replace_substring(parted, " ", NUL + " "), "\n", f"{NUL}\n{NUL}")
        return pc.split_pattern(parted, NUL)


@lru_cache(maxsize=2)
def encoder(vocabulary):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    return Encoder(vocabulary)


def _encoded(batch, vocabulary):
    """(ids, serialized texts) of a batch in runs of bounded text, equal texts of a run encoded once."""
    texts = batch.column(1).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        table = texts.slice(at, to - at).dictionary_encode()
        found = encoder(vocabulary).encode(table.dictionary)
        yield batch.column(0).slice(at, to - at), [found[i] for i in table.indices.to_pylist()]
        at = to


def train_dictionary(docs, vocabulary, sample_docs=SAMPLE_DOCS, sample_bytes=SAMPLE_BYTES):
    """Dictionary bytes from a bounded sample of short documents, or b"" if they are too few."""
    short = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, sample_bytes))
    share = max(1, docs.count() // (4 * sample_docs))
    drawn = F.xxhash64(F.lit("dictionary"), "doc_id", "text")
    drawn_docs = short.withColumn("d", drawn).filter(F.pmod("d", F.lit(share)) == 0)
    picked = drawn_docs.orderBy("d").limit(sample_docs).select("doc_id", "text")

    def encode(batches):
        for batch in batches:
            for _, encoded in _encoded(batch, vocabulary):
                yield pa.RecordBatch.from_pydict({"ids": pa.array(encoded, pa.binary())})

    samples = [bytes(r[0]) for r in picked.mapInArrow(encode, "ids binary").collect()]  # at most sample_docs
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs, path, vocabulary, dictionary=None):
    """Write shards below ``path``; gives the frame (shard, path, n_docs, n_ids), one row per shard."""
    spark = docs.sparkSession
    trained = train_dictionary(docs, vocabulary) if dictionary is None else dictionary
    digest = hashlib.sha256(trained).digest() if trained else NO_DICTIONARY
    write_file(f"{path}/{digest.hex()}.dictionary", trained)

    def write(batches):
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:06d}"
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        out, ids, ends, counts = None, [], [], []
        for batch in batches:
            for doc_ids, encoded in _encoded(batch, vocabulary):
                if out is None:
                    out = Written(f"{name}.tok")
                    out.write(MAGIC + digest)
                for data in encoded:
                    out.write(press.compress(data))
                    ends.append(out.at)
                    counts.append(len(data) // 4)
                ids.append(doc_ids)
        if out is None:
            return
        out.close()
        starts = [len(MAGIC) + len(digest), *ends[:-1]]
        index = pa.table(
            {
                "doc_id": pa.concat_arrays(ids),
                "offset": pa.array(starts, pa.int64()),
                "length": pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
            }
        )
        sidecar = Written(f"{name}.index")
        buffer = pa.BufferOutputStream()
        pq.write_table(index, buffer)
        sidecar.write(buffer.getvalue().to_pybytes())
        sidecar.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [name], "n_docs": [len(counts)], "n_ids": [sum(counts)]}
        )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text")).repartitionByRange(n, "doc_id", "k").sortWithinPartitions("doc_id", "k")
    shards = rows.select("doc_id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long")
    return stage(shards, "token-shards")


@lru_cache(maxsize=4)
def _dictionary(folder, digest):
    if digest == NO_DICTIONARY:
        return None
    trained = read_file(f"{folder}/{digest.hex()}.dictionary")
    if hashlib.sha256(trained).digest() != digest:
        raise ValueError(f"the dictionary below {folder} is not the one its shards name")
    return zstandard.ZstdCompressionDict(trained)


def _open(name):
    """(open shard, its decompressor, its index as a table)."""
    at, path = store(f"{name}.tok")
    f = at.open_input_file(path)
    head = f.read_at(len(MAGIC) + 32, 0)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{name} is not a token shard")
    unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(name.rsplit("/", 1)[0], head[len(MAGIC) :]))
    index = pq.read_table(pa.BufferReader(read_file(f"{name}.index")))
    return f, unpress, index


def read_document(name, doc_id):
    """Ids of one document of a shard, read through the index; None if it is not there."""
    f, unpress, index = _open(name)
    with f:
        for row in index.to_pylist():
            if row["doc_id"] == doc_id:
                return np.frombuffer(unpress.decompress(f.read_at(row["length"], row["offset"])), dtype="<u4")
    return None


def read_tokens(spark, shards):
    """(doc_id, start, n_tokens, ids_crc32, shard, offset, length) of each document, from the files."""
    listed, start = [], 0
    for shard, path, _, n_ids in sorted(tuple(r) for r in shards.collect()):  # one row per shard
        listed.append((shard, path, start))
        start += n_ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f, unpress, index = _open(row["path"])
                with f:
                    at = row["start"]
                    for part in index.to_batches(max_chunksize=4096):
                        offsets, lengths = part.column("offset").to_pylist(), part.column("length").to_pylist()
                        counts, crcs, starts = [], [], []
                        for offset, length in zip(offsets, lengths):
                            data = unpress.decompress(f.read_at(length, offset))
                            counts.append(len(data) // 4)
                            crcs.append(zlib.crc32(data))
                            starts.append(at)
                            at += counts[-1]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": part.column("doc_id"), "start": pa.array(starts, pa.int64()),
                                "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                                "shard": pa.array([row["shard"]] * len(part), pa.int64()),
                                "offset": part.column("offset"), "length": part.column("length"),
                            }
                        )

    files = spark.createDataFrame(listed, "shard long, path string, start long").repartition(max(1, len(listed)))
    return files.mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long, length long"
    )


def token_files(docs, vocabulary, path=None):
    """Write all documents below the shared folder and read them back."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, path, vocabulary))
