"""WARC archives by way of a chunked record table.

``chunk_rows`` streams each payload as (row, chunk number) rows of at most
``CHUNK_BYTES``, with the SHA-256 of the payload up to the end of the chunk, so
nothing beside the cell itself holds a whole record. ``write_archives`` turns
every chunk into one WARC record: a record of several chunks is segmented as the
format provides (WARC-Segment-Number, continuation records, total length in the
last). Of records with equal payloads of at least ``REVISIT_BYTES``, the one of
the smallest id is a response and the others are revisits without a block.

Spark's text writer puts the records out, with the two line ends that close a
record as line separator, and its reader finds them again by the line end and
version line that open one, also inside large files that are read in splits. A
chunk is cut wherever the payload spells that version mark, so no block can pass
for a record; Content-Length is checked on every block. ``read_archives``
deals the segments of a record to one task in order and feeds them through one
running digest, which must equal the digest in the header.

Null payloads are empty. Records of null id are responses and are never referred
to; equal rows (id and payload) share one fate. Empty tables give archives
without records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from triageflow.llm.common import bound_batches, stored

CHUNK_BYTES = 1 << 16
REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000
DATE = "1970-01-01T00:00:00Z"
MARK = b"WARC/1.1"
VERSION = MARK + b"\r\n"
OPENS = "\r\nWARC/1.1\r\n"
CLOSES = "\r\n\r\n"


def chunk_ends(payload: bytes, size: int = CHUNK_BYTES) -> list[int]:
    """Ends of the chunks: every ``size`` bytes, and two bytes into every
    version mark that the payload spells (the line ends around it may be the
    header's or the closing ones)."""
    cuts, at = [], payload.find(MARK)
    while at >= 0:
        cuts.append(at + 2)
        at = payload.find(MARK, at + 2)
    out, start = [], 0
    for end in [*cuts, len(payload)]:
        out += [*range(start + size, end, size), end]
        start = end
    return out


def chunks(payload: bytes, size: int = CHUNK_BYTES):
    """(chunk number, start, end, SHA-256 of the payload so far)."""
    view, digest, start = memoryview(payload), hashlib.sha256(), 0
    for k, end in enumerate(chunk_ends(payload, size)):
        digest.update(view[start:end])
        yield k, start, end, digest.hexdigest()
        start = end


_DIGESTS = "id bigint, payload_bytes bigint, payload_digest string"
_CHUNKS = ("id bigint, url string, record string, chunk int, n_chunks int, data binary, running_digest string, "
           "payload_bytes bigint, payload_digest string")


def _digest_rows(size: int):
    def run(batches):
        for b in batches:
            payloads = [p.as_buffer() if p.is_valid else pa.py_buffer(b"") for p in b.column("payload")]
            last = []
            for p in payloads:
                view, digest = memoryview(p), hashlib.sha256()
                for at in range(0, len(view), size):
                    digest.update(view[at:at + size])
                last.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([p.size for p in payloads], pa.int64()), pa.array(last)],
                                             names=["id", "payload_bytes", "payload_digest"])
    return run


def _chunk_rows(size: int, limit: int = 4 << 20):
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        from pyspark import TaskContext
        task, row, held, bytes_held = TaskContext.get().partitionId(), 0, [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)
        for b in batches:
            for i, url, p in zip(b.column("id").to_pylist(), b.column("url").to_pylist(), b.column("payload")):
                payload = p.as_py() or b""
                parts = list(chunks(payload, size))
                record, row = f"{task}-{row}", row + 1
                for k, s, e, running in parts:
                    held.append((i, url, record, k, len(parts), payload[s:e], running, len(payload), parts[-1][3]))
                    bytes_held += e - s + 500
                    if bytes_held >= limit:
                        yield flush()
                        held, bytes_held = [], 0
        if held:
            yield flush()

    return run


def _payloads(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    return pages.select(F.col(record_id).cast("bigint").alias("id"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("payload"))


def digests(spark: SparkSession, pages: DataFrame, record_id: str, payload: str, size: int = CHUNK_BYTES) -> DataFrame:
    """``id, payload_bytes, payload_digest``, one row per row of ``pages``."""
    bound_batches(spark)
    return pages.select(F.col(record_id).cast("bigint").alias("id"), F.col(payload).cast("binary").alias("payload")).mapInArrow(_digest_rows(size), _DIGESTS)


def chunk_rows(spark: SparkSession, pages: DataFrame, record_id: str, url: str, payload: str, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table."""
    bound_batches(spark)
    return _payloads(pages, record_id, url, payload).mapInArrow(_chunk_rows(size), _CHUNKS)


def revisits(spark: SparkSession, digest: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``id, payload_digest, refers_to`` of the rows that revisit another."""
    digest = stored(spark, digest.where((F.col("payload_bytes") >= least) & F.col("id").isNotNull())
                    .select("id", "payload_digest").distinct(), "payload-digests")
    first = stored(spark, digest.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n"))
                   .where("n > 1").select("payload_digest", "refers_to"), "first-payloads")
    return stored(spark, digest.join(first, "payload_digest").where("id <> refers_to"), "revisits")


def write_archives(spark: SparkSession, pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url",
                   payload: str = "html", size: int = CHUNK_BYTES, compression: str = "gzip") -> None:
    """Write ``pages`` as WARC files under ``path``."""
    again = revisits(spark, digests(spark, pages, record_id, payload, size))
    rows = chunk_rows(spark, pages, record_id, url, payload, size).join(again, ["id", "payload_digest"], "left")
    rows = rows.where("refers_to is null or chunk = 0")
    revisit, last = F.col("refers_to").isNotNull(), F.col("chunk") == F.col("n_chunks") - 1
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    line = lambda name, value, when=None: F.when(when if when is not None else F.lit(True), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))
    many = (F.col("n_chunks") > 1) & ~revisit
    head = F.concat_ws(
        "", F.lit(VERSION.decode()), line("WARC-Type", F.when(revisit, "revisit").when(F.col("chunk") > 0, "continuation").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), "record", F.lit("-"), "chunk", F.lit(">"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"), F.col("url").isNotNull()), line("Content-Type", F.lit("text/html")),
        line("X-Source-ID", F.col("id"), F.col("id").isNotNull()),
        line("X-Refers-To-Source-ID", F.col("refers_to"), revisit),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), line("X-Payload-Length", F.col("payload_bytes")),
        line("WARC-Segment-Number", F.col("chunk") + 1, many), line("X-Running-Digest", F.concat(F.lit("sha256:"), "running_digest"), many),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:record:"), "record", F.lit("-0>")), many & (F.col("chunk") > 0)),
        line("WARC-Segment-Total-Length", F.col("payload_bytes"), many & last),
        line("Content-Length", F.length(block)), F.lit("\r\n"))
    out = rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))
    out.write.option("lineSep", CLOSES).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased) and block of one record without its version line."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError(f"WARC record without an end of header: {raw[:80]!r}")
    fields = {}
    for one in raw[:end].decode("utf-8", "replace").split("\r\n"):
        name, _, value = one.partition(": ")
        fields[name.lower()] = value
    length = int(fields["content-length"])
    block = raw[end + 4:end + 4 + length]
    if len(block) != length or raw[end + 4 + length:].strip(b"\r\n"):
        raise ValueError(f"WARC block of {len(raw) - end - 4} bytes, {length} announced")
    return fields, block


_SEGMENTS = ("origin string, segment int, id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
             "payload_digest string, data binary")
_RECORDS = "id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _segments(batches):
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    number = lambda f, k: int(f[k]) if k in f else None
    for b in batches:
        out = []
        for raw in b.column(0).to_pylist():
            raw = raw.removeprefix(VERSION)  # of the first record of a file
            if not raw:
                continue
            f, block = parse_record(raw)
            out.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number(f, "warc-segment-number") or 1, number(f, "x-source-id"),
                        f.get("warc-target-uri"), f["warc-type"], number(f, "x-refers-to-source-id"), number(f, "x-payload-length"),
                        f["warc-payload-digest"].removeprefix("sha256:"), block))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def _whole(batches):
    """Drop the block of records that are complete in one segment and right."""
    for b in batches:
        keep = []
        for kind, segment, length, want, block in zip(*(b.column(c).to_pylist() for c in ("record_type", "segment", "payload_bytes", "payload_digest", "data"))):
            whole = kind == "response" and segment == 1 and len(block) == length
            if whole and hashlib.sha256(block).hexdigest() != want:
                raise ValueError(f"WARC payload does not have its digest {want}")
            keep.append(None if whole or kind == "revisit" else block)
        yield b.set_column(b.schema.get_field_index("data"), "data", pa.array(keep, pa.binary()))


def _assembled(batches):
    """Records from their segments in order; one digest runs over a record."""
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    digest, seen, next_segment, record = None, 0, 1, None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["data"] is not None:
                if r["segment"] == 1:
                    digest, seen, next_segment, record = hashlib.sha256(), 0, 1, r
                if record is None or r["origin"] != record["origin"] or r["segment"] != next_segment:
                    raise ValueError(f"WARC segment {r['segment']} of {r['origin']} is out of order")
                digest.update(r["data"])
                seen, next_segment = seen + len(r["data"]), next_segment + 1
                if seen < r["payload_bytes"]:
                    continue
                if seen > r["payload_bytes"] or digest.hexdigest() != r["payload_digest"]:
                    raise ValueError(f"WARC payload does not have its digest {r['payload_digest']}")
                r = record
            out.append((r["id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every WARC record under ``path`` as a chunk row: ``origin`` (id of the
    record's first segment), ``segment``, header fields and ``data``."""
    bound_batches(spark)
    raw = spark.read.option("lineSep", OPENS).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(_segments, _SEGMENTS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``id, url, payload_bytes, payload_digest, record_type, refers_to`` per
    record, with every payload checked against its digest."""
    segments = read_segments(spark, path).mapInArrow(_whole, _SEGMENTS)
    return segments.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_assembled, _RECORDS)
