"""Operator 9: WARC archives of pages, with revisit records, and their reading with segment reassembly."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.storage import attempt_name, resolve, slices
from lumivox.plans.joins import split_join
from lumivox.plans.scratch import written

WRITTEN = "name string, digest string, key string, record_id string"
RECORD = "record_id string, origin_id string, segment int, total long, kind string, uri string, key string, refers_id string, digest string, block binary"
CHUNK = 4096
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _head(fields: dict[str, object], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _http(payload: bytes | None) -> bytes:
    """A response whose body is in chunked framing; only its head where the payload is left to another record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if payload is None:
        return head
    chunks = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return head + b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in [*chunks, b""])


def _record_id(*place: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, place)))}>"


def _records(own: str, key, url, html: str | None, digest: str, refers: str | None, most: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and the continuations that hold its rest. ``refers`` is the response's record."""
    revisit = refers is not None
    block = _http(None if revisit else html.encode())
    parts = [block[i : i + most] for i in range(0, len(block), most)]
    common = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": own,
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else "".join(c if c.isprintable() and c != " " else "%{:02X}".format(ord(c)) for c in url),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "WARC-Page-Key": key,
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Refers-To": refers,
        "Content-Type": "application/http;msgtype=response",
    }
    for i, part in enumerate(parts):
        fields = common if i == 0 else {"WARC-Type": "continuation", "WARC-Record-ID": _record_id(own, i), "WARC-Date": common["WARC-Date"], "WARC-Segment-Origin-ID": own}
        if len(parts) > 1:
            fields = fields | {"WARC-Segment-Number": i + 1}
            if i == len(parts) - 1:
                fields["WARC-Segment-Total-Length"] = len(block)
        yield _head(fields, len(part)) + part + b"\r\n\r\n"


def _write_files(rows: DataFrame, folder: str, segment: int) -> DataFrame:
    """Writes ``key, url, html, digest, refers, asked`` to a gzipped file a task: a row for each file, and one for each record that is ``asked`` for.

    Records have identifiers of the place they are written at, so repeated rows are records of their own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = resolve(folder)
        store.create_dir(top)
        name, out, count = attempt_name(TaskContext.get().partitionId()) + ".warc.gz", None, 0
        for batch in slices(batches, "html"):
            out = out or store.open_output_stream(f"{top}/{name}", compression=None)
            told = []
            for row in batch.to_pylist():
                own = _record_id(top, name, count)
                for record in _records(own, row["key"], row["url"], row["html"], row["digest"], row["refers"], segment):
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(member.compress(record) + member.flush())
                    count += 1
                if row["asked"]:
                    told.append({"name": name, "digest": row["digest"], "key": None if row["key"] is None else str(row["key"]), "record_id": own})
            yield pa.RecordBatch.from_pylist(told, _TOLD)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name}], _TOLD)

    return written(rows.select("key", "url", "html", "digest", "refers", "asked").mapInArrow(write, WRITTEN), "archives")


_TOLD = pa.schema([(n, pa.string()) for n in ("name", "digest", "key", "record_id")])


def write_warc(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, segment: int = 16384) -> list[str]:
    """Writes a record a page to gzipped WARC files in ``folder`` and returns their names (one a task and kind of record).

    The payload is the page's html in UTF-8, empty for null. Of pages with equal payloads of ``least`` bytes or
    more the one with the largest key is the response and the others revisit it (rows that repeat that key are
    responses too, of which revisits name one; rows with a null key revisit, or are responses if no page of theirs has a
    key). Responses are written first, so that revisits can give the identifier that their response's record has.
    Blocks longer than ``segment`` bytes go to continuation records. A task writes a file of its own name and
    commits it by a manifest row. An empty table writes no file; extra columns are left out. A page of many MB is held whole by the task
    that writes it, once, and its records are cut from it. Large groups of copies are matched by a join that
    Spark can split, after their largest keys are pre-aggregated; revisits take no html through it.
    """
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("key").alias("first"), (F.count("*") > 1).alias("asked"))
    matched = split_join(rows, first, "digest", "left")  # equal digests have equal sizes
    own = F.col("first").isNull() | F.col("key").eqNullSafe(F.col("first"))
    responses = _write_files(matched.where(own).withColumn("refers", F.lit(None).cast("string")).withColumn("asked", F.coalesce("asked", F.lit(False))), folder, segment)

    named = responses.where("record_id IS NOT NULL AND key IS NOT NULL").groupBy("digest").agg(F.min("record_id").alias("refers"), F.max("key").alias("first"))
    again = split_join(rows.where(F.col("size") >= least).drop("html", "size"), named, "digest").where(~F.col("key").cast("string").eqNullSafe(F.col("first")))
    revisits = _write_files(again.withColumn("html", F.lit("")).withColumn("asked", F.lit(False)), folder, segment)
    return sorted(r["name"] for r in responses.select("name").unionByName(revisits.select("name")).distinct().collect())


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file one by one, whatever the file's size."""
    rest, one, out = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            break
        out.append(one.decompress(data))
        if one.eof:
            yield b"".join(out)
            rest, one, out = one.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("an archive ends within a record")


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    f = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(f["content-length"])
    if len(rest) < length:
        raise ValueError("a record is shorter than its Content-Length")
    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
    return {
        "record_id": f["warc-record-id"],
        "origin_id": f.get("warc-segment-origin-id") or (f["warc-record-id"] if number else None),
        "segment": int(number) if number else None,
        "total": int(total) if total else None,
        "kind": f["warc-type"],
        "uri": f.get("warc-target-uri"),
        "key": f.get("warc-page-key"),
        "refers_id": f.get("warc-refers-to"),
        "digest": base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in f else None,
        "block": rest[:length],
    }


def read_records(spark: SparkSession, folder: str, names: list[str], segmented: bool | None = None) -> DataFrame:
    """The records of the files as they stand; only segments, or only whole records, if asked. A task reads a file record by record.

    A file that ends within a record fails the job, and so does one that isn't WARC.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = resolve(folder)
        rows, size = [], 0
        for batch in batches:
            for i in batch.column("id").to_pylist():
                with store.open_input_stream(f"{top}/{names[i]}", compression=None) as f:
                    for member in _members(f):
                        row = _parsed(member)
                        if segmented is not None and segmented != (row["origin_id"] is not None):
                            continue
                        rows.append(row)
                        size += len(row["block"])
                        if size >= 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("key", pa.string()), ("refers_id", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
    if not names:
        return spark.createDataFrame([], RECORD)
    return spark.range(len(names), numPartitions=len(names)).mapInArrow(read, RECORD)


def _payload(block: bytes) -> bytes | None:
    """A response block's body, out of its chunked framing; None where there is only a head."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"\r\ntransfer-encoding: chunked" not in head.lower():
        return body
    if not body:
        return None
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _joined(origin: str, total: int | None, segments: list[dict]) -> bytes:
    """A record's block from its segments, sorted by number; an error where one is missing or the length is another."""
    block = b"".join(s["block"] for s in segments)
    if total is not None and (total != len(block) or [s["segment"] for s in segments] != list(range(1, len(segments) + 1))):
        raise ValueError(f"segments are missing of {origin}")
    return block


def read_warc(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``record_id, kind, uri, key, refers_id, digest, payload``: whole records, whatever files their segments are in.

    Segments are grouped by the identifier of the record they continue, ordered by number, joined once, and held against
    the total length that the last one states; a gap, or another length, fails the job. Segments that are there twice
    count once. A group is one record, so it is as large as that record. ``payload`` is null for revisits.
    """
    kept = ("kind", "uri", "key", "refers_id", "digest")
    whole = read_records(spark, folder, names, segmented=False)
    whole = whole.select("record_id", *kept, F.lit(None).cast("long").alias("total"), F.array(F.struct("segment", "block")).alias("segments"))
    parts = read_records(spark, folder, names, segmented=True).dropDuplicates(["origin_id", "segment"]).groupBy(F.col("origin_id").alias("record_id"))
    found = parts.agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in kept],
        F.coalesce(F.max("total"), F.lit(-1)).cast("long").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"),
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                held = zip(*(some.column(c).to_pylist() for c in ("record_id", "total", "segments")))
                payloads = pa.array([_payload(_joined(*row)) for row in held], pa.binary())
                yield pa.record_batch([*some.columns[:-2], payloads], names=[*some.schema.names[:-2], "payload"])

    return whole.unionByName(found).mapInArrow(decode, "record_id string, kind string, uri string, key string, refers_id string, digest string, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``key, uri, kind, payload_bytes, payload_digest, refers_key`` of read records: what a revisit leaves out comes from the record it names.

    Digests are computed from the payloads; a revisit's must equal that of its response, and there must be such a record, else the job fails.
    """
    digested = records.select("record_id", "key", "uri", "kind", "refers_id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    digested = written(digested, "records")
    own = digested.where(F.col("refers_id").isNull()).withColumn("refers_key", F.lit(None).cast("string"))
    full = own.dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_id"), "payload_bytes", "payload_digest", F.col("key").alias("refers_key"))
    found = digested.where(F.col("refers_id").isNotNull()).drop("payload_bytes", "payload_digest").join(full, "refers_id", "left")
    same = F.coalesce(F.col("payload_digest") == F.col("digest"), F.lit(False))
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its digest: "), F.coalesce("refers_id", "record_id"))))
    return own.unionByName(found).select("key", "uri", "kind", "payload_bytes", checked.alias("payload_digest"), "refers_key")
