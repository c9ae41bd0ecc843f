"""WARC archives: write, normalise whole-file gzip to one member per record, read by offset index.

``write_archives`` writes one record per page, each file as a single gzip stream, as some crawlers
leave them. ``normalise`` inflates such a stream once, in pieces, rewrites every record as a gzip
member of its own and leaves a sidecar index (record, offset, length, type). ``read_archives`` reads
the members through the index and checks each payload against its digest.

Of pages with equal payloads the one with the largest id is the response; the others revisit it and
carry no payload, only its digest and, in their HTTP header, its length.

Defined cases: a null page is an empty payload; a null id is named "none", is a response if no
other id has its payload and a revisit else; repeated rows of the largest id are all responses; a
null address has no target line; an empty table writes no archive; extra columns are ignored.
Memory holds one record at a time beside the reading buffer. Lost tasks write their file anew.
"""

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, stage
from .files import Written, read_file, store
from .words import whole

DATE = "2000-01-01T00:00:00Z"
LEVEL = 1
PIECE = 1 << 20
GAP = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def assign_records(pages):
    """(page_id, url, html, payload_bytes, sha1, refers_to) with html null for revisits."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        whole(F.col("html")).alias("html"),
    )
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    same = rows.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # Written first, so that a payload holding a large share of all pages can be split in the join.
    same = stage(same.filter("n > 1").drop("n"), "warc-equal")
    rows = rows.join(same, "sha1", "left")
    revisit = F.coalesce(F.col("page_id") < F.col("first_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull())
    return rows.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"),
        F.octet_length("html").cast("bigint").alias("payload_bytes"), "sha1",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _name(page_id):
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name):
    number = re.fullmatch(r"<urn:page:(.*)>", name)[1]
    return None if number == "none" else int(number)


def record(page_id, url, html, payload_bytes, sha1, refers_to):
    """One WARC record as bytes."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    if html is not None:
        block += html.encode()
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + GAP + block + GAP


def headers(head):
    """Named fields of a header block, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def write_archives(pages, path):
    """Write all pages, one gzip stream per file; gives the frame (path, n_records)."""

    def write(batches):
        part = TaskContext.get().partitionId()
        name, out, n = f"{path}/raw-{part:06d}.warc.gz", None, 0
        for batch in batches:
            columns = [c for c in batch.columns]
            for i in range(len(batch)):
                if out is None:
                    out = Written(name)
                    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(press.compress(record(*(c[i].as_py() for c in columns))))
                n += 1
        if out is not None:
            out.write(press.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]})

    return stage(assign_records(pages).mapInArrow(write, "path string, n_records long"), "warc-raw")


def inflate(f):
    """Pieces of plain text of a gzip file of one or many members, each inflated once."""
    stream = zlib.decompressobj(31)
    while data := f.read(PIECE):
        while data:
            if plain := stream.decompress(data, PIECE):
                yield plain
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)
    if plain := stream.flush():
        yield plain


def records(pieces):
    """Whole records, each from its version line to its closing gap, from a stream of pieces."""
    held = bytearray()
    want = 0  # bytes the record at hand needs, once its header is read
    for piece in pieces:
        held += piece
        while True:
            if not want:
                cut = held.find(GAP)
                if cut < 0:
                    break
                want = cut + len(GAP) + int(headers(bytes(held[:cut]))["content-length"]) + len(GAP)
            if len(held) < want:
                break
            yield bytes(held[:want])
            del held[:want]
            want = 0
    if held:
        raise ValueError("the archive ends inside a record")


def normalise(spark, archives, path):
    """Rewrite each file of ``archives`` (a frame with path) below ``path``: one member per record
    and a sidecar index; gives the frame (path, n_records)."""

    def rewrite(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = f"{path}/{source.rsplit('/', 1)[1]}"
                out, offsets, lengths, names, kinds = Written(name), [], [], [], []
                at, plain_path = store(source)
                with at.open_input_file(plain_path) as f:
                    for data in records(inflate(f)):
                        member = gzip.compress(data, compresslevel=LEVEL, mtime=0)
                        fields = headers(data[: data.index(GAP)])
                        offsets.append(out.at)
                        lengths.append(len(member))
                        names.append(fields["warc-record-id"])
                        kinds.append(fields["warc-type"])
                        out.write(member)
                out.close()
                buffer = pa.BufferOutputStream()
                pq.write_table(pa.table({"record": names, "offset": offsets, "length": lengths, "type": kinds}), buffer)
                index = Written(f"{name}.index")
                index.write(buffer.getvalue().to_pybytes())
                index.close()
                yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(names)]})

    paths = archives.select("path").repartition(max(1, archives.count()))
    return stage(paths.mapInArrow(rewrite, "path string, n_records long"), "warc-normal")


def parse(data):
    """(page_id, payload_bytes, digest, type, refers_to) of a record, its payload checked."""
    cut = data.index(GAP)
    fields = headers(data[:cut])
    block = data[cut + len(GAP) : cut + len(GAP) + int(fields["content-length"])]
    end = block.index(GAP)
    size = int(headers(block[:end])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    refers = _id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    if fields["warc-type"] == "response":
        payload = block[end + len(GAP) :]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    return _id(fields["warc-record-id"]), size, digest, fields["warc-type"], refers


def read_record(path, offset, length):
    """One record by its place in the index."""
    at, plain_path = store(path)
    with at.open_input_file(plain_path) as f:
        return gzip.decompress(f.read_at(length, offset))


def read_archives(spark, archives):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length)."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                index = pq.read_table(pa.BufferReader(read_file(f"{path}.index")), columns=["offset", "length"])
                at, plain_path = store(path)
                with at.open_input_file(plain_path) as f:
                    for part in index.to_batches(max_chunksize=4096):
                        offsets, lengths = part.column("offset").to_pylist(), part.column("length").to_pylist()
                        rows = [parse(gzip.decompress(f.read_at(n, o))) for o, n in zip(offsets, lengths)]
                        ids, sizes, digests, kinds, refers = zip(*rows)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "page_id": pa.array(ids, pa.int64()), "payload_bytes": pa.array(sizes, pa.int64()),
                                "payload_digest": digests, "record_type": kinds,
                                "refers_to": pa.array(refers, pa.int64()), "archive": [path] * len(rows),
                                "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64()),
                            }
                        )

    paths = archives.select("path").repartition(max(1, archives.count()))
    return paths.mapInArrow(
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "archive string, offset long, length long",
    )


def archive_pages(pages, path=None):
    """Write, normalise and read back all pages."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    raw = write_archives(pages, f"{path}/raw")
    return read_archives(spark, normalise(spark, raw, f"{path}/records"))
