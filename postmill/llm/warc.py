"""WARC archives by index: writing yields, for every record, its file, offset, length, URL and
digest; reading selects in the index first and then fetches the selected byte ranges in order,
neighbours in one read.

Archives are gzip members, one per record, written through the file system of the shared folder's
URI. A task writes files of new names and the index keeps those of tasks that ended well, so a
repeated or lost task leaves at most a file that no index row names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: A file is closed beyond this size; neighbours are read together up to READ bytes (a power of two), over
#: gaps of up to GAP. Most tasks that read.
FILE, READ, GAP = 1 << 30, 8 << 20, 64 << 10
TASKS = 50_000
_ID = "urn:postmill:page:"


def _record(page_id, url, sha1: str, payload: bytes | None, size: int, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes) -> tuple:
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: int(n) if (n := fields[name][1 + len(_ID) : -1]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers_to = None
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    else:
        refers_to, payload = number("WARC-Refers-To"), None
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], refers_to, payload


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the index.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is
    a response, the others are revisits without the payload; smaller ones are all responses. A null
    html is an empty payload, a null url is left out, a null page_id sorts last. Of repeated rows of a
    page_id with one payload one is the response and the others are revisits to their own page_id. Other
    columns are ignored; an empty table gives an empty index."""
    folder = folder or scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("sha1"))
    narrow = rows.select("page_id", "url", "size", "sha1")
    first = written(narrow.filter(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first")), "warc-first")
    # Only responses need their text, and each is found by its own page_id, so no group of equal
    # payloads meets in one task; revisits are found without texts. What is joined was written before, so
    # that Spark can split the partition of a very common payload.
    known = first.select(F.col("sha1").alias("s"), "first")
    same = F.col("sha1") == F.col("s")
    stands = same & F.col("page_id").eqNullSafe(F.col("first"))
    kept = rows.filter(F.col("size") >= least)
    responses = kept.join(known, stands, "left_semi")
    revisits = narrow.filter(F.col("size") >= least).join(known, same & ~F.col("page_id").eqNullSafe(F.col("first"))).drop("s")
    # Of rows that share page_id and payload with the response, all but one are revisits.
    twice = narrow.filter(F.col("size") >= least).join(known, stands, "left_semi").groupBy("sha1").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("sha1").alias("s"))
    twice = written(twice, "warc-twice")
    if not twice.isEmpty():
        again = written(narrow.join(known, stands).drop("s").join(twice, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "warc-again")
        one = again.groupBy("sha1").agg(F.min("row").alias("one")).select(F.col("sha1").alias("s"), "one")
        again = again.join(one, same & (F.col("row") != F.col("one"))).drop("s", "row", "one")
        responses = responses.join(twice, same, "left_anti").union(responses.join(twice, same, "left_semi").dropDuplicates(["sha1"]))
        revisits = revisits.unionByName(again.select(*revisits.columns))
    none = F.lit(None)
    records = (
        responses.select("page_id", "url", "html", "size", "sha1", none.cast("long").alias("refers_to"))
        .union(revisits.select("page_id", "url", none.cast("string"), "size", "sha1", "first"))
        .union(rows.filter(F.col("size") < least).select("page_id", "url", "html", "size", "sha1", none.cast("long")))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None or offset > FILE:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    payload = None if row["html"] is None else row["html"].encode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(_record(row["page_id"], row["url"], row["sha1"], payload, row["size"], row["refers_to"], date)) + packer.flush()
                    out.write(data)
                    index.append((name, offset, len(data), row["url"], row["sha1"], row["page_id"], "revisit" if payload is None else "response"))
                    offset += len(data)
                yield _batch(index, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
        finally:
            if out is not None:
                out.close()

    return written(records.mapInArrow(write, INDEX), "warc-index").withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the index
    rows given (select there first); other columns are ignored. Ranges are dealt by file and stretch of
    ``READ`` bytes, sorted, and neighbours fetched in one read; the digest of every response is verified. The
    number of tasks follows the bytes to read, not those of the index. A row that is repeated in the index
    is read again; an empty index gives no records; a null page_id or url comes back as null, an empty
    payload as empty bytes, that of a revisit, or of any record without ``payload``, as null."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, -(-total // max(READ, -(-total // TASKS))))
    stretch = F.floor(F.col("offset") / READ)
    ordered = index.select("file", "offset", "length").repartition(int(tasks), F.col("file"), stretch).sortWithinPartitions("file", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def fetch(name: str, ranges: list[tuple[int, int]], handles: dict) -> list[tuple]:
        if name not in handles:
            for h in handles.values():
                h.close()
            handles.clear()
            system, path = fs.FileSystem.from_uri(name)
            handles[name] = system.open_input_file(path)
        first = ranges[0][0]
        data = handles[name].read_at(max(o + n for o, n in ranges) - first, first)
        parsed = [_parse(data[o - first : o - first + n]) for o, n in ranges]
        return parsed if payload else [p[:-1] + (None,) for p in parsed]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ranges, handles = "", [], {}
        for batch in batches:
            for f, o, n in zip(*(c.to_pylist() for c in batch.columns)):
                end = ranges[-1][0] + ranges[-1][1] if ranges else 0
                if ranges and (f != name or o - end > GAP or o + n - ranges[0][0] > READ):
                    yield _batch(fetch(name, ranges, handles), schema)
                    ranges = []
                name = f
                ranges.append((o, n))
        if ranges:
            yield _batch(fetch(name, ranges, handles), schema)
        for h in handles.values():
            h.close()

    return ordered.mapInArrow(read, RECORD)
