"""WARC records as a chunked record table.

An archive is a table of ``(record_id, chunk_no, n_chunks, header, payload, prefix_sha256)`` rows. A
record's header block stands in its first chunk; the payload is cut into chunks of at most ``CHUNK``
bytes, so neither writer nor reader needs a buffer of a whole record's size beyond the input cell.
``prefix_sha256`` is the SHA-256 of the payload up to and with the chunk: the writer carries one digest
state along a record, the reader carries its own along the chunks in order and compares the two after
each, so damage shows at the chunk where it is; the last chunk's is the payload's digest. Header, then
payload chunks in order, then CRLF CRLF, give the record's bytes as in a WARC/1.1 file.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Largest payload piece of a row, in bytes.
CHUNK = 1 << 16
#: Payloads shorter than this are never written as revisits.
MIN_REVISIT = 100
#: Bits of the map of hashes of payloads that occur more than once: 128 KB, whatever the input; where it fills, more payloads move.
MAP_BITS = 1 << 20
#: Payload bytes of a written batch.
BATCH = 1 << 22
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARCHIVE = "record_id string, chunk_no int, n_chunks int, header string, payload binary, prefix_sha256 string"


def record_id(id_: Column, uri: Column, digest: Column) -> Column:
    """The name of a record: its id, if any, and a hash of address and payload, so that rows of one id have records of their own."""
    rest = F.substring(F.sha2(F.to_json(F.struct(uri.alias("uri"), digest.alias("digest"))), 256), 1, 32)
    return F.when(id_.isNull(), F.concat(F.lit("<urn:page-without-id:"), rest, F.lit(">"))).otherwise(F.concat(F.lit("<urn:page:"), id_.cast("string"), F.lit(":"), rest, F.lit(">")))


def page_of(name: Column) -> Column:
    """The id in a record's name as text; null where the page has none."""
    return F.when(name.startswith("<urn:page:"), F.regexp_extract(name, r"(?s)^<urn:page:(.*):[0-9a-f]{32}>$", 1))


def _described(records: DataFrame) -> DataFrame:
    """``id, uri, bytes, digest, key`` of every row of ``id, uri, payload``; no payload moves."""
    return records.select("id", "uri", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.xxhash64("payload").alias("key"))


def _headers(rows: DataFrame, date: str) -> DataFrame:
    """Add ``record_id`` and ``head`` to rows of ``id, uri, bytes, digest, first``; a set ``first`` (id, uri) makes a revisit."""
    revisit = F.col("first").isNotNull()
    crlf = "\r\n"
    own_id = record_id(F.col("id"), F.col("uri"), F.col("digest"))
    head = F.concat(
        F.lit("WARC/1.1" + crlf + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(crlf + "WARC-Record-ID: "), own_id, F.lit(f"{crlf}WARC-Date: {date}"),
        F.lit(crlf + "WARC-Target-URI: "), F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]", " "),
        F.lit(crlf + "WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(crlf + "WARC-Refers-To: "), record_id(F.col("first.id"), F.col("first.uri"), F.col("digest")), F.lit(f"{crlf}WARC-Profile: {_REVISIT_PROFILE}"))).otherwise(""),
        F.lit(crlf + "Content-Type: text/html; charset=utf-8" + crlf + "Content-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"), F.lit(crlf + crlf),
    )
    return rows.withColumns({"record_id": own_id, "head": head})


def _cut(chunk: int):
    """Rows of ``record_id, head, payload`` -> chunk rows, with one digest state and no copy of the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "chunk_no", "n_chunks", "header", "payload", "prefix_sha256"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for name, head, payload in zip(batch.column("record_id").to_pylist(), batch.column("head").to_pylist(), batch.column("payload"), strict=True):
                view, digest = memoryview(payload.as_buffer()), hashlib.sha256()
                n = max(1, -(-len(view) // chunk))
                for no in range(n):
                    piece = view[no * chunk : (no + 1) * chunk]
                    digest.update(piece)
                    rows.append((name, no, n, head if no == 0 else None, piece, digest.copy().hexdigest()))
                    size += len(piece)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0

    return run


def _bit_map(keys: DataFrame) -> Column:
    """A literal array of bit maps (of a fixed size together) with a bit for each ``key``."""
    bucket, bit = F.expr(f"pmod(key, {MAP_BITS}) DIV 32768"), F.expr(f"pmod(key, {MAP_BITS}) % 32768")
    maps = keys.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()  # at most MAP_BITS / 32768 rows of 4 KB
    held = {r["bucket"]: bytes(r["bits"]) for r in maps}
    return F.array(*[F.lit(held.get(b, b"")) for b in range(MAP_BITS // 32768)])


def _in_map(bits: Column, key: Column) -> Column:
    """Whether the key's bit is set; true for every key of the map and for a few others."""
    place = F.pmod(key, F.lit(MAP_BITS))
    held = F.element_at(bits, (F.floor(place / 32768) + 1).cast("int"))
    byte = F.conv(F.hex(F.substring(held, (F.floor((place % 32768) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def write_chunks(records: DataFrame, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """The archive of rows of ``id, uri, payload`` (binary), in the shared folder; ``date`` (UTC, default now) stands in every header.

    Of records of equal payloads of ``MIN_REVISIT`` bytes or more, that of the smallest id, and of that id
    the one of the smallest address (a null one first), is a response and the others are revisits with a
    header and no payload. An exact repeat of a row is written once; other rows of one id are records of
    their own. Ids and digests settle who is what. A payload that occurs once, told by a bit map of
    fixed size, is written where it stands; of the others only responses' payloads move, dealt by id and
    digest, so equal payloads do not meet in one task.
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    told = materialize(_described(records), "warc-digests")
    place = F.struct("id", "uri")
    groups = told.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("id").isNotNull(), place)).alias("least"), F.first("bytes").alias("bytes"))
    again = materialize(groups.where("n > 1").select(F.col("digest").alias("d"), "least", (F.col("bytes") >= MIN_REVISIT).alias("revisited")), "warc-repeated")
    shared = told.join(again, F.col("digest") == F.col("d")).drop("d")
    revisit = F.col("revisited") & F.col("least").isNotNull() & ~(F.col("id").eqNullSafe(F.col("least.id")) & F.col("uri").eqNullSafe(F.col("least.uri")))
    shared = materialize(shared.withColumn("revisit", revisit).select("id", "uri", "bytes", "digest", "key", "revisit", F.when(revisit, F.col("least")).alias("first")).distinct(), "warc-shared")
    none = hashlib.sha256().hexdigest()
    revisits = _headers(shared.where("revisit"), date).select("record_id", F.lit(0).alias("chunk_no"), F.lit(1).alias("n_chunks"), F.col("head").alias("header"), F.lit(b"").alias("payload"), F.lit(none).alias("prefix_sha256"))

    bits = _bit_map(shared.select("key"))
    often = _in_map(bits, F.xxhash64("payload"))
    described = lambda rows: rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256), "first": F.lit(None).cast(shared.schema["first"].dataType)})
    once = described(records.where(~often))
    moved = described(records.where(often))
    told_once = moved.join(again.select("d"), F.col("digest") == F.col("d"), "left_anti")  # the map's false hits
    first = shared.where("NOT revisit").select(F.col("id").alias("i"), F.col("uri").alias("u"), F.col("digest").alias("d"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("uri").eqNullSafe(F.col("u")) & (F.col("digest") == F.col("d"))
    responses = moved.join(first, same, "left_semi").dropDuplicates(["id", "uri", "digest"])
    whole = once.unionByName(told_once).unionByName(responses)
    chunks = _headers(whole, date).select("record_id", "head", "payload").mapInArrow(_cut(chunk), _ARCHIVE)
    return materialize(chunks.unionByName(revisits), "warc")


def _digest_stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by record and chunk -> a row per record; one digest state and one chunk at a time."""
    key, header, digest, size, seen = None, None, None, 0, 0
    schema = pa.schema([("record_id", pa.string()), ("header", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("chunks", pa.int64())])
    for batch in batches:
        done = []
        for name, no, head, payload, carried in zip(*(batch.column(c) for c in ("record_id", "chunk_no", "header", "payload", "prefix_sha256")), strict=True):
            if (name := name.as_py()) != key or no.as_py() == 0:
                if digest:
                    done.append((key, header, size, digest.hexdigest(), seen))
                key, header, digest, size, seen = name, head.as_py(), hashlib.sha256(), 0, 0
            if no.as_py() != seen:
                raise ValueError(f"chunk {seen} of {name} is missing")
            digest.update(view := payload.as_buffer())
            if digest.copy().hexdigest() != carried.as_py():
                raise ValueError(f"chunk {seen} of {name} is damaged")
            size, seen = size + len(view), seen + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)] if done else [pa.array([], f.type) for f in schema], schema=schema)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, header, size, digest.hexdigest(), seen), schema, strict=True)], schema=schema)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """A row per record of an archive table, with the length and digest of the payload as it was read.

    Columns: ``record_id, record_type, refers_to_record, target_uri, declared_digest, read_bytes,
    read_digest, complete`` (``complete``: all chunks are there and the payload has the length that
    the header declares). A record of one chunk is checked in place; the chunks of larger records meet
    in order by record. A missing chunk, or one whose carried digest is not that of what was read, stops
    the job.
    """
    own = F.sha2("payload", 256)
    checked = F.when(own == F.col("prefix_sha256"), own).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))))
    single = chunks.where("n_chunks = 1").select("record_id", "header", F.octet_length("payload").cast("long").alias("bytes"), checked.alias("digest"), F.lit(1).cast("long").alias("chunks"), F.lit(1).cast("long").alias("n_chunks"))
    large = chunks.where("n_chunks > 1")
    streamed = large.select("record_id", "chunk_no", F.when(F.col("chunk_no") == 0, F.concat(F.col("n_chunks").cast("string"), F.lit(";"), "header")).alias("header"), "payload", "prefix_sha256")
    streamed = streamed.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_digest_stream, "record_id string, header string, bytes long, digest string, chunks long")
    streamed = streamed.select("record_id", F.expr("substring(header, instr(header, ';') + 1)").alias("header"), "bytes", "digest", "chunks", F.substring_index("header", ";", 1).cast("long").alias("n_chunks"))
    read = single.unionByName(streamed)
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    return read.select(
        "record_id", field("WARC-Type").alias("record_type"), field("WARC-Refers-To").alias("refers_to_record"), field("WARC-Target-URI").alias("target_uri"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("declared_digest"), F.col("bytes").alias("read_bytes"), F.col("digest").alias("read_digest"),
        ((F.col("chunks") == F.col("n_chunks")) & (F.col("bytes") == field("Content-Length").cast("long"))).alias("complete"),
    )


def archive_bytes(rows: Iterable[tuple[str | None, bytes]]) -> Iterator[bytes]:
    """The bytes of a WARC file from ``(header, payload)`` chunk rows in order, a chunk at a time."""
    open_ = False
    for header, payload in rows:
        if header is not None:
            if open_:
                yield b"\r\n\r\n"
            yield header.encode("utf-8")
            open_ = True
        yield payload
    if open_:
        yield b"\r\n\r\n"


def parse_archive(stream, chunk: int = CHUNK) -> Iterator[tuple[str, int, str | None, bytes]]:
    """Chunk rows ``(record_id, chunk_no, header, payload)`` of a WARC file that is read as a stream."""
    while True:
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line)
        if not lines and line == b"":
            return
        if not lines:
            continue
        header = (b"".join(lines) + b"\r\n").decode("utf-8")
        left = int(re.search(r"(?im)^content-length: *(\d+)", header)[1])
        name, no = re.search(r"(?im)^warc-record-id: *(\S+)", header)[1], 0
        while no == 0 or left:
            payload = stream.read(min(chunk, left))
            if len(payload) < min(chunk, left):
                raise ValueError(f"{name} ends too early")
            left -= len(payload)
            yield name, no, header if no == 0 else None, payload
            no += 1


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Write every page as a WARC record to an archive table in the shared folder and read it back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``; length and digest of a
    response are those of the bytes that were read back, a revisit takes those of the response it
    names. A null html is an empty payload and a null url an empty header field. An exact repeat of a row
    counts as the same page and gives one row; rows of one id that differ in address or payload give a
    row each. A null id is never the one referred to. An empty table gives no rows; other columns are
    ignored.
    """
    records = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    read = read_chunks(write_chunks(records, chunk))
    page = page_of(F.col("record_id")).cast(pages.schema[id_col].dataType)
    read = read.withColumn("id", page)
    ok = F.when(F.col("complete") & ((F.col("read_digest") == F.col("declared_digest")) | (F.col("record_type") == "revisit")), F.col("declared_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))))
    read = materialize(read.select("id", "record_id", "record_type", "refers_to_record", "read_bytes", ok.alias("payload_digest")), "warc-read")
    responses = read.where("record_type = 'response'").select("id", "record_id", F.col("read_bytes").alias("payload_bytes"), "payload_digest")
    revisits = read.where("record_type = 'revisit'").select("id", "refers_to_record")
    targets = responses.where(F.col("payload_bytes") >= MIN_REVISIT).select(F.col("record_id").alias("refers_to_record"), F.col("id").alias("refers_to"), "payload_bytes", "payload_digest")
    followed = revisits.join(targets, "refers_to_record").select("id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    plain = responses.select("id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to"))
    return plain.unionByName(followed).withColumnRenamed("id", id_col)


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
