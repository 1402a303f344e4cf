"""WARC archives with an index: write records, index them, read selected records back by coalesced byte ranges.

Every record is a gzip member of its own, so any one can be read alone. Responses hold an HTTP response whose body is
the payload; revisits hold its head only, with the length and digest of the payload that they leave out. Each task writes one archive under a new name
in the shared folder and returns the index rows of that file; the index is written as Parquet, so only files of tasks
that succeeded are ever referred to. Reading goes through the index: records are sorted by offset, neighbours are
read together, and each file is cut into ranges that are separate rows of work.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 100
INDEX = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, file string, offset long, length long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _filesystem(path: str):
    """The file system of a URI and the path in it: local, or whichever store pyarrow can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


#: Date of pages that have none of their own: the same in every run.
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    """A URI for the capture of a page with this payload: the same whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member. A page without a url is named by its id; fields that the format lacks
    begin with X-."""
    clean = "".join((url or "").split()) or f"urn:page:{'' if page_id is None else page_id}"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date or NO_DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        body += payload
    head += [f"X-Page: {'' if page_id is None else page_id}", f"X-Url: {'null' if url is None else 'text' if url.split() else 'empty'}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and the payload in it (of a revisit: nothing)."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, date, digest, refers_to); refers_to is null for a response. Only digests that occur twice are joined back."""
    date = F.date_format(F.col("date").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if "date" in pages.columns else F.lit(None).cast("string")
    p = pages.select(date.alias("date"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = C.save(first, "repeated")  # a table, so that its size is known when the join is planned
    return p.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and return their index (a table in the scratch folder).

    pages: page_id, url, html, and if there is one, a timestamp `date` (UTC in the session's time zone), else NO_DATE; so has a page whose `date` is no timestamp.
    A null url is read back as null, white space inside one is left out; a null html is an empty payload. Payloads of
    fewer than LEAST bytes are always responses. page_id should be unique; if it is not, equal ids with equal payloads are
    all responses, with the same record id.
    """
    C.narrow_batches(pages.sparkSession)
    folder = folder or f"{C.scratch_dir(pages.sparkSession)}/warc"

    def run(batches):
        fs, root = _filesystem(folder)
        out = None
        try:
            for batch in batches:
                rows = []
                if out is None:
                    fs.create_dir(root, recursive=True)
                    base = f"{uuid.uuid4().hex}.warc.gz"
                    name = f"{folder}/{base}"
                    out, at = fs.open_output_stream(f"{root}/{base}", compression=None), 0
                for r in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "refers_to", "date")), strict=True):
                    page, url, payload, digest, refers, date = (x.as_py() for x in r)
                    kind = "response" if refers is None else "revisit"
                    data = record(kind, page, url, payload, digest, refers, date)
                    out.write(data)
                    rows.append((page, url, kind, refers, digest, len(payload), name, at, len(data)))
                    at += len(data)
                yield _batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return C.save(classify(pages).select("page_id", "url", "payload", "digest", "refers_to", "date").mapInArrow(run, INDEX), "index")


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def read(index: DataFrame, with_payload: bool = True, stretch: int = 8 << 20, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """Read the records that the index rows name.

    Rows of one file and one stretch of `stretch` bytes come together, sorted by offset; ranges less than `gap` apart
    are one read of at most about `most` bytes. Lengths and digests are computed from what was read; for revisits
    they are the ones in the record's header.
    """
    def run(batches):
        file, handle, fs = None, None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            offset, length = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            new = np.zeros(len(names), bool)
            new[:1] = True
            ends = offset + length
            starts = 0
            for i in range(1, len(names)):
                new[i] = names[i] != names[i - 1] or offset[i] - ends[i - 1] > gap or offset[i] < ends[i - 1] or ends[i] - offset[starts] > most
                starts = i if new[i] else starts
            cuts = [*np.flatnonzero(new), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if names[a] != file:
                    file = names[a]
                    fs, path = _filesystem(file)
                    handle = fs.open_input_file(path)
                handle.seek(int(offset[a]))
                data = handle.read(int(ends[b - 1] - offset[a]))
                rows = []
                for i in range(a, b):
                    h, body = parse(data[offset[i] - offset[a]: ends[i] - offset[a]])
                    page = int(h["X-Page"]) if h["X-Page"] else None
                    url = {"null": None, "empty": ""}.get(h["X-Url"], h["WARC-Target-URI"])
                    if h["WARC-Type"] == "revisit":
                        rows.append((page, url, "revisit", int(h["X-Refers-To-Page"]), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][7:], None))
                    else:
                        rows.append((page, url, "response", None, len(body), hashlib.sha256(body).hexdigest(), body if with_payload else None))
                yield _batch(rows, READ)

    work = index.select("file", "offset", "length").withColumn("_s", F.floor(F.col("offset") / stretch))
    work = work.repartition(C.partitions(index.sparkSession), "file", "_s").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return work.mapInArrow(run, READ)
