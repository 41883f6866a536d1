"""WARC archives with an index (operator 9).

Writing: every page becomes one gzip member holding one WARC/1.1 record.  Of pages with equal payloads of
at least 100 bytes, the one with the smallest page_id is a response and the others are revisits of it, which carry
the HTTP header but no payload.  Each task writes one archive into the shared folder under a name of its own and returns
its index rows, file, offset, length, url and digest per record; the index table is committed by Spark, so an archive of a
task that failed and ran again is never referred to.

Reading: the selected index rows are dealt out by file and sorted by offset; neighbouring byte ranges with gaps of up
to GAP bytes are coalesced into single reads of at most READ bytes, and the records in them parsed.

Files are opened by their whole URI, which the index holds, through pyarrow's file systems, so the folder may be on any
store that they know.  Record ids are unique: page, archive and offset.  A revisit names its response by the page and by
the payload's digest, as the response may lie in an archive not written yet.

Defined results: a null html is the empty payload, a null url the empty URL.  Rows that repeat the smallest page_id of
their payload are all responses.  A null page_id is never a response to others; alone it is one.  Other columns do not
take part.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import dropped, small, temporary, written

LEAST_PAYLOAD = 100
GAP = 64 << 10
READ = 8 << 20
BROADCAST_ROWS = 100_000
INDEX = "file string, offset long, length long, url string, digest string, page_id {}, record_type string, refers_to {}"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _id(page) -> str:
    """A page's id in a header: nothing for null, text behind = with all but letters, digits and ``_.-~`` escaped."""
    return "" if page is None else "=" + quote(page, safe="") if isinstance(page, str) else str(page)


def _from_id(shown: str) -> str | int | None:
    return None if shown == "" else unquote(shown[1:]) if shown[0] == "=" else int(shown)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, place: str = "0:0") -> bytes:
    """One WARC record; refers_to is None for a response, `place` tells records of one page apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = lambda i: f"<urn:page:{_id(i)}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)[:-1]}:{place}>", f"WARC-Target-URI: {_clean(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Type, page id, url, payload size and digest of a record; a response's digest is that of its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    else:
        size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else ""
    return {"record_type": fields["WARC-Type"], "page": _from_id(bare(fields["WARC-Record-ID"]).rsplit(":", 2)[0]), "refers_to": _from_id(bare(fields.get("WARC-Refers-To"))), "bytes": size, "digest": digest, "payload": payload}


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The committed index of the archives of all `pages` (``page_id, url, html``), written to a folder (a whole URI).

    Without a folder they are temporary: they go with the tables of the shared folder.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    folder = folder or temporary(spark, "warc")
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    groups = body.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    body = body.join(small(groups, BROADCAST_ROWS), "digest", "left").withColumn("refers_to", F.expr("if(page_id <=> first, null, first)"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        archive, at, out = uuid.uuid4().hex, 0, None
        name = f"{folder}/{archive}.warc.gz"
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    out = out or store.open_output_stream(f"{path}/{archive}.warc.gz", compression=None)
                    press = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = press.compress(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], f"{archive}:{at}")) + press.flush()
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data), "url": r["url"], "digest": r["digest"], "page_id": r["page_id"], "record_type": "response" if r["refers_to"] is None else "revisit", "refers_to": r["refers_to"]})
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=index_schema)
        finally:
            if out:
                out.close()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = INDEX.format(kind, kind)
    index_schema = to_arrow_schema(StructType.fromDDL(ddl))
    index = written(body.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, ddl), "index")
    dropped(groups)
    return index


def ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of index rows, sorted by offset, that one read covers."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > GAP or r["offset"] + r["length"] - run[0]["offset"] > READ):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of the records in `index`, which may be any selection."""
    kind = dict(index.dtypes)["page_id"]
    ddl = f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            for run in ranges(batch.to_pylist()):
                if name != run[0]["file"]:
                    name = run[0]["file"]
                    store, path = pa.fs.FileSystem.from_uri(name)
                    opened = store.open_input_file(path)
                begin = run[0]["offset"]
                data = opened.read_at(run[-1]["offset"] + run[-1]["length"] - begin, begin)
                rows = []
                for r in run:
                    p = parsed(zlib.decompress(data[r["offset"] - begin : r["offset"] - begin + r["length"]], 31))
                    rows.append({"page_id": p["page"], "payload_bytes": p["bytes"], "payload_digest": p["digest"], "record_type": p["record_type"], "refers_to": p["refers_to"], "payload": p["payload"]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    files = max(1, index.select("file").distinct().count())  # index rows are small but stand for large reads: a task per file
    selected = index.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset")
    return selected.mapInArrow(read, ddl)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    return read_records(write_archives(pages)).drop("payload")
