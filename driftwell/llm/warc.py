"""WARC archives with an index of records (operator 4).

Writing: each task writes one archive, a gzip member for each record, to the shared folder, and returns an
index row for each record: file, offset, length, url, digest. The index is itself a table; a repeated task
writes a file of its own, and only the files that the index names count. Of records with equal payloads of
at least REVISIT_BYTES bytes, the one with the largest page_id is a response and the others are revisits
that refer to it.

Reading: the wanted index rows are sorted by file and offset, neighbouring byte ranges are coalesced into
one read if the gap between them is small, and the records are parsed from what was read.

Null html is an empty payload; a null url is written as the record's own id. A null page_id is smaller than
all others; a page_id that is not a number is an error. Equal rows give equal records: rows that share the
largest page_id are all responses. A payload whose digest is not that of its header and of the index is an
error. A very long payload is one record of one task. Extra columns are not read. An empty table gives an
empty index.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

REVISIT_BYTES = 1000
#: Ranges of one file that are at most this far apart are read together, up to MAX_READ bytes.
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
#: Bytes of one file that stay together, and of all that a reading task takes at most.
SLICE, TASK_BYTES = 1 << 20, 64 << 20
INDEX = "page_id long, file string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to long"
_CRLF = b"\r\n"


def _store(place: str):
    """The file system of a place and the path in it; the scheme may be one that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. The block is an HTTP response, whose Content-Length is that of the full payload
    in revisits also, which leave the payload itself out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _name(page_id).encode(),
        b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", _name(page_id) if url is None else url).encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _name(refers_to).encode()]
    body = block if revisit else block + payload
    return _CRLF.join([*head, b"Content-Length: %d" % len(body), b"", body, b"", b""])


def parse(data: bytes, digest: str | None = None) -> dict:
    """The fields of one record, the digest taken from the payload where there is one. Damage is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(_CRLF)[1:])
    body = rest[: int(fields[b"Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: None if x == b"none" else int(x)
    page = lambda x: number(x[len(b"<urn:page:") : -1])
    revisit = fields[b"WARC-Type"] == b"revisit"
    if not revisit and len(payload) != size:
        raise ValueError(f"record {fields[b'WARC-Record-ID']!r} is cut off")
    said = fields[b"WARC-Payload-Digest"][5:].decode()
    own = said if revisit else hashlib.sha1(payload).hexdigest()
    if own != said or digest not in (None, said):
        raise ValueError(f"record {fields[b'WARC-Record-ID']!r} has another digest than its header or its index")
    return {
        "page_id": page(fields[b"WARC-Record-ID"]),
        "url": fields[b"WARC-Target-URI"].decode(),
        "payload_bytes": size,
        "payload_digest": own,
        "record_type": fields[b"WARC-Type"].decode(),
        "refers_to": page(fields[b"WARC-Refers-To"]) if revisit else None,
        "payload": b"" if revisit else payload,
    }


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest and what the record refers to. Payloads are compared by their digest,
    length and a second hash; the join is on narrow keys, and one of many rows can be split."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    same = own.where(f"n >= {REVISIT_BYTES}").groupBy(F.col("digest").alias("d"), F.xxhash64("html").alias("x"), F.col("n").alias("m")).agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    joined = own.join(same, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")) & (F.xxhash64("html") == F.col("x")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives into ``folder``, which all executors share, and return their index."""
    place = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, offset = None, None, 0
        try:
            for frame in frames:
                rows = []
                for x in frame.itertuples(index=False):
                    number, to = (None if pd.isna(v) else int(v) for v in (x.page_id, x.refers_to))
                    payload = x.html.encode()
                    if out is None:
                        store, path = _store(place)
                        store.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(number, x.url, payload, x.digest, to, x.revisit)) + packer.flush()
                    out.write(data)
                    rows.append((number, name, offset, len(data), x.url, x.digest, len(payload), "revisit" if x.revisit else "response", to))
                    offset += len(data)
                made = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield made.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    index = written(planned(pages, page_id, url, html).mapInPandas(run, INDEX), "warc-index")
    return index.withColumn("folder", F.lit(place))


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, and
    with ``payloads`` also url and payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, last = None, None
        for frame in frames:
            rows, wanted, k = [], list(frame.itertuples(index=False)), 0
            while k < len(wanted):
                first = end = k
                stop = wanted[k].offset + wanted[k].length
                while end + 1 < len(wanted) and (nxt := wanted[end + 1]).file == wanted[k].file and nxt.offset - stop <= MAX_GAP and max(stop, nxt.offset + nxt.length) - wanted[k].offset <= MAX_READ:
                    end, stop = end + 1, max(stop, nxt.offset + nxt.length)
                if (wanted[k].folder, wanted[k].file) != last:
                    if source is not None:
                        source.close()
                    store, path = _store(wanted[k].folder)
                    source, last = store.open_input_file(f"{path}/{wanted[k].file}"), (wanted[k].folder, wanted[k].file)
                data = source.read_at(stop - wanted[k].offset, wanted[k].offset)
                for x in wanted[first : end + 1]:
                    at = x.offset - wanted[first].offset
                    got = parse(zlib.decompress(data[at : at + x.length], 31), x.digest)
                    rows.append([got[c] for c in names])
                k = end + 1
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    # slices of files are dealt over tasks by the archives' bytes, not by those of the index
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    usual = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-total // TASK_BYTES), min(usual, -(-total // SLICE)))
    dealt = index.select("folder", "file", "offset", "length", "digest").repartition(tasks, "file", F.floor(F.col("offset") / SLICE)).sortWithinPartitions("folder", "file", "offset")
    return dealt.mapInPandas(run, schema)


#: What comes back from the archives, in DuckDB SQL over ``pages``.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM q
"""
