"""WARC: a deterministic sharded writer, and its reader.

Records are range-sorted by id, each range is written by one task, which rolls
to a new file when WARC_BYTES compressed bytes are reached; every record is a
gzip member of its own, with regenerated headers and digests. Files are
written under temporary names, renamed when whole, and committed by a manifest.
Dates and record ids derive from the record, so equal input gives equal bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import _common as c

#: A file is closed when it has so many compressed bytes.
WARC_BYTES = 64_000_000
#: Payloads below this many bytes are always written whole.
REVISIT_FROM = 1000
#: Records aimed at for each range.
RECORDS_PER_RANGE = 5_000
#: Fixed values of the format: version line, revisit profile, and the date written for all records.
VERSION, PROFILE, DATE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Parts that the rows of one payload are spread over when they meet its response.
SALT = 16


def payload(column: str) -> Column:
    return F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")


def plan(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """id, digest, bytes, record_type and refers_to of each record: of equal payloads of REVISIT_FROM bytes or more the largest id responds.

    Digests meet after partial aggregation, and only payloads that occur under several ids come back to the rows, spread over SALT parts.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload(payload_col)).alias("digest"), F.octet_length(payload(payload_col)).cast("long").alias("bytes"))
    big = rows.where(F.col("bytes") >= REVISIT_FROM).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").drop("first")
    big = big.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(big, ["digest", "bytes", "salt"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def record_id(page_id: int | None, digest: str, again: int = 0) -> str:
    """The id of a page's record of a payload; again: how many such records come before it."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'record:{page_id}:{digest}:{again}')}>"


def record(page_id: int | None, url: str | None, body: bytes, digest: str, kind: str, refers_to: int | None, again: int = 0) -> bytes:
    """One record with its HTTP block, as a gzip member without a time stamp."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + b"Content-Length: %d\r\n\r\n" % len(body)
    block = http + body if kind == "response" else http
    sha1 = b32encode(bytes.fromhex(digest)).decode()
    target = "".join(x for x in url or "" if x >= " ")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, again)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ranges: int | None = None, roll_bytes: int = WARC_BYTES) -> DataFrame:
    """Writes one record per row of pages below path and returns the manifest: file, records, bytes.

    A null payload is empty, a null url an empty target; a null id sorts first
    and is written with an empty id. Rows that share an id are all written,
    with record ids of their own; where the shared id is a payload's largest, all its rows respond. A payload
    is revisited only where two known ids have it. The
    payloads are shuffled once, into their ranges, together with the small rows that say how to write them.
    """
    spark = pages.sparkSession
    how = plan(pages, id_col, payload_col)
    bodies = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload(payload_col)).alias("digest"), F.lit(1).alias("part"), F.col(url_col).cast("string").alias("url"), payload(payload_col).alias("body"), F.lit(None).cast("string").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    meta = how.select("page_id", "digest", F.lit(0).alias("part"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "record_type", "refers_to").distinct()
    n = ranges or max(spark.sparkContext.defaultParallelism, pages.count() // RECORDS_PER_RANGE + 1)
    sorted_rows = meta.unionByName(bodies).repartitionByRange(n, F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "digest", "part", F.col("url").asc_nulls_first())
    done = sorted_rows.mapInArrow(_writer(path, roll_bytes), "file string, records long, bytes long").collect()
    c.write_file(path, "manifest.json", iter([json.dumps([r.asDict() for r in sorted(done, key=lambda r: r.file)]).encode()]))
    return spark.createDataFrame(sorted((tuple(r) for r in done), key=lambda r: r[0]), "file string, records long, bytes long")


def _writer(path: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        done: list[dict] = []

        def rows() -> Iterator[dict]:
            kind, refers = "response", None
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    for row in batch.slice(start, 64).to_pylist():
                        if row["part"] == 0:
                            kind, refers = row["record_type"], row["refers_to"]
                        else:
                            yield row | {"record_type": kind, "refers_to": refers}

        waiting = rows()
        row = next(waiting, None)
        last, again = None, 0  # rows of one id and payload follow each other
        while row is not None:
            count = 0

            def chunks() -> Iterator[bytes]:
                nonlocal row, count, last, again
                size = 0
                while row is not None and size < roll_bytes:
                    body = row["body"]
                    key = row["page_id"], hashlib.sha1(body).hexdigest()
                    last, again = key, again + 1 if key == last else 0
                    member = record(row["page_id"], row["url"], body, key[1], row["record_type"], row["refers_to"], again)
                    size += len(member)
                    count += 1
                    yield member
                    row = next(waiting, None)

            name = f"part-{part:06d}-{len(done):04d}.warc.gz"
            size = c.write_file(path, name, chunks())
            done.append({"file": name, "records": count, "bytes": size})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    waiting = b""
    while True:
        opened, out = zlib.decompressobj(31), []
        while not opened.eof:
            waiting = waiting or stream.read(1 << 16)
            if not waiting:
                if out and any(out):
                    raise ValueError("the archive ends inside a record")
                return
            out.append(opened.decompress(waiting))
            waiting = opened.unused_data
        yield b"".join(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's headers, HTTP headers and payload, after its block digest is checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    return headers, http, body


def read(spark: SparkSession, manifest: DataFrame, path: str, keep_payload: bool = True) -> DataFrame:
    """Each record of the files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and with keep_payload the payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = c.filesystem(path)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + keep_payload]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for member in members(stream):
                        headers, http, body = parse(member)
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        whole = headers["WARC-Type"] == "response"
                        digest = hashlib.sha1(body).hexdigest() if whole else _hex(headers["WARC-Payload-Digest"])
                        if digest != _hex(headers["WARC-Payload-Digest"]):
                            raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                        rows.append((int(headers["X-Page-Id"]) if headers["X-Page-Id"] else None, headers["WARC-Target-URI"], len(body) if whole else size, digest, headers["WARC-Type"], int(headers["X-Refers-To-Page-Id"]) if not whole else None, body if whole else None)[: 6 + keep_payload])
                        if len(rows) == 128:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    n = max(1, manifest.count())
    return manifest.select("file").repartition(n, "file").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if keep_payload else ""))


def _hex(digest: str) -> str:
    from base64 import b32decode

    return b32decode(digest.removeprefix("sha1:")).hex()
