"""WARC archives through a chunked record table: written by Spark, read back in pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefeat.llm.common import materialise

CHUNK = 1 << 20
VERSION = "WARC/1.1\r\n"
CHUNK_SCHEMA = ("record string, source_row string, chunk int, n_chunks int, payload_bytes long, running_digest string, "
                "line binary")
RECORD_SCHEMA = ("record string, source_row string, record_id string, refers_to string, record_type string, chunk int, "
                 "payload_bytes long, payload_digest string, body binary")
RESULT_SCHEMA = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def _boundary(key: str) -> str:
    return f"{VERSION}X-Boundary: {key}\r\n"


def make_chunker(key: str, chunk: int, date: str):
    """mapInArrow function: (id, url, payload, leader, leader_url) -> rows of the chunked record table."""
    lead_in = _boundary(key)

    def chunks(batches):
        import base64
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0

        def name(page, digest):
            return f"<urn:page:{'null' if page is None else page}:{digest}>"

        def b32(h):
            return base64.b32encode(h.digest()).decode()

        def clean(v):
            return "" if v is None else " ".join(str(v).split())

        def flush(rows):
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        schema = pa.schema([("record", pa.string()), ("source_row", pa.string()), ("chunk", pa.int32()),
                            ("n_chunks", pa.int32()), ("payload_bytes", pa.int64()), ("running_digest", pa.string()),
                            ("line", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                page, url, leader, leader_url, sha = (batch.column(i)[r].as_py() for i in (0, 1, 3, 4, 5))
                data = memoryview(batch.column(2)[r].as_buffer())        # no copy of the payload
                n, tag = len(data), f"{part}-{row}"
                row += 1
                total = base64.b32encode(bytes.fromhex(sha)).decode()
                record = name(page, total)
                http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {n}\r\n\r\n").encode()
                revisit = leader is not None and page != leader
                n_chunks = 1 if revisit else max(1, -(-n // chunk))
                running = hashlib.sha1()
                for k in range(n_chunks):
                    piece = b"" if revisit else data[k * chunk:(k + 1) * chunk]
                    running.update(piece)
                    kind = "revisit" if revisit else "response" if k == 0 else "continuation"
                    block = (http if k == 0 else b"") + bytes(piece)
                    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record if k == 0 else record[:-1] + f':{k + 1}>'}",
                            f"WARC-Date: {date}", f"WARC-Target-URI: {clean(url)}", f"X-Source-Row: {tag}",
                            f"X-Page: {'' if page is None else page}", f"WARC-Payload-Digest: sha1:{total}"]
                    if k == 0:
                        head.append("Content-Type: application/http; msgtype=response")
                    if revisit:
                        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                 f"WARC-Refers-To: {name(leader, total)}", f"X-Refers-To-Page: {leader}",
                                 f"WARC-Refers-To-Target-URI: {clean(leader_url)}"]
                    elif n_chunks > 1:
                        head += [f"WARC-Segment-Number: {k + 1}", f"X-Running-Digest: sha1:{b32(running)}"]
                        if k:
                            head.append(f"WARC-Segment-Origin-ID: {record}")
                        if k == n_chunks - 1:
                            head.append(f"WARC-Segment-Total-Length: {n + len(http)}")
                    head.append(f"Content-Length: {len(block)}")
                    line = (lead_in + "\r\n".join(head) + "\r\n\r\n").encode() + block
                    rows.append({"record": record, "source_row": tag, "chunk": k, "n_chunks": n_chunks,
                                 "payload_bytes": n, "running_digest": total if revisit else b32(running),
                                 "line": line})
                    held += len(line)
                    if held >= 8 * chunk:
                        yield flush(rows)
                        rows, held = [], 0
        if rows:
            yield flush(rows)
    return chunks


def chunk_table(pages: DataFrame, key: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                chunk_bytes: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The chunked record table: one row per record and chunk of at most ``chunk_bytes`` payload bytes.

    Columns record, source_row, chunk, n_chunks, payload_bytes, running_digest
    (SHA-1 of the payload up to and including the chunk) and ``line``, the
    bytes of a WARC record (larger payloads become a segmented record:
    response, then continuations).  Of pages with equal payloads the one with
    the largest id is the response, the others revisit it.  A null payload is
    an empty one; a null id never leads unless all ids of its payload are
    null, in which case all are responses; rows repeating the leading id are
    all responses.  Other columns of ``pages`` are ignored.  Only the ids of
    repeated payloads are joined back; Catalyst broadcasts them when they are
    small and shuffles otherwise.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("num"), F.col(url_col).cast("string").alias("url"),
                     payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    lead = p.groupBy("sha").agg(F.max(F.when(F.col("num").isNotNull(), F.struct("num", "id", "url"))).alias("lead"),
                                F.count(F.lit(1)).alias("n"))
    lead = materialise(lead.where("n > 1").select("sha", F.col("lead.id").alias("leader"),
                                                  F.col("lead.url").alias("leader_url")), "warc-leaders")
    rows = p.join(lead, "sha", "left").select("id", "url", "payload", "leader", "leader_url", "sha")
    return rows.mapInArrow(make_chunker(key, chunk_bytes, date), CHUNK_SCHEMA)


def write_archives(pages: DataFrame, folder: str, **kw) -> str:
    """Write ``pages`` as WARC files under ``folder``; returns the boundary key that ``read_archives`` needs.

    Spark's text writer stores the record bytes as they are, one row after the
    other with CRLF CRLF behind each, on any file system Spark can write.  The
    first header field of every record is a random key of this write, so a
    reader can cut files anywhere without mistaking payload bytes for a record.
    """
    key = uuid.uuid4().hex
    table = chunk_table(pages, key, **kw)
    table.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)
    return key


def make_parser():
    """mapInArrow function: raw record pieces -> header fields, and digest and length where a record is whole."""
    def parse(batches):
        import base64
        import hashlib

        import pyarrow as pa
        schema = pa.schema([("record", pa.string()), ("source_row", pa.string()), ("record_id", pa.string()),
                            ("refers_to", pa.string()), ("record_type", pa.string()), ("chunk", pa.int32()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("body", pa.binary())])
        for batch in batches:
            rows = []
            for cell in batch.column(0):
                raw = memoryview(cell.as_buffer())
                if not len(raw):
                    continue
                cut = _find(raw, b"\r\n\r\n")
                head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                            for line in bytes(raw[:cut]).decode().split("\r\n"))
                body = raw[cut + 4:cut + 4 + int(head["Content-Length"])]
                if len(body) != int(head["Content-Length"]):
                    raise ValueError(f"record {head.get('WARC-Record-ID')} is cut short")
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind, seg = head["WARC-Type"], head.get("WARC-Segment-Number")
                size = None
                if kind != "continuation":
                    cut = _find(body, b"\r\n\r\n")
                    http = dict(x.split(": ", 1) for x in bytes(body[:cut]).decode().split("\r\n")[1:])
                    size, body = int(http["Content-Length"]), body[cut + 4:]
                if kind == "response" and seg is None:
                    found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if found != digest or len(body) != size:
                        raise ValueError(f"record {head['WARC-Record-ID']}: payload and header differ")
                rows.append({"record": head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]),
                             "source_row": head["X-Source-Row"], "record_id": head["X-Page"] or None,
                             "refers_to": head.get("X-Refers-To-Page"),
                             "record_type": kind, "chunk": int(seg or 1) if seg or kind != "revisit" else 1,
                             "payload_bytes": size, "payload_digest": digest,
                             "body": bytes(body) if seg else None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _find(view, mark, step=4096):
        """Offset of ``mark`` in ``view``, copying only the part in front of it."""
        end = step
        while True:
            at = bytes(view[:end]).find(mark)
            if at >= 0:
                return at
            if end >= len(view):
                raise ValueError("no end of header")
            end *= 2
    return parse


def make_folder_of_chunks():
    """mapInArrow function over rows sorted by record and chunk: one row per record, digests fed chunk by chunk."""
    def fold(batches):
        import base64
        import hashlib

        import pyarrow as pa
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        head, seen, digest = None, 0, None

        def done():
            if digest is not None:
                found = base64.b32encode(digest.digest()).decode()
                if found != head["payload_digest"] or seen != head["payload_bytes"]:
                    raise ValueError(f"record {head['record']}: chunks and header differ")
            return {k: head[k] for k in schema.names}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if head is None or (r["record"], r["source_row"]) != (head["record"], head["source_row"]):
                    if head is not None:
                        out.append(done())
                    if r["record_type"] == "continuation":
                        raise ValueError(f"record {r['record']}: first chunk is missing")
                    head, seen, digest = r, 0, None
                if r["body"] is not None:
                    digest = digest or hashlib.sha1()
                    digest.update(r["body"])
                    seen += len(r["body"])
                    r["body"] = None
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)
    return fold


def read_archives(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """One row per record of ``folder``: record_id, record_type, refers_to, payload_bytes, payload_digest.

    Files are cut at record boundaries wherever Spark splits them.  Whole
    records are digested where they are read; only the chunks of segmented
    ones are moved, sorted by record and chunk, and digested one chunk at a
    time.  Lengths and digests are compared with the headers; a difference
    raises.
    """
    raw = spark.read.option("lineSep", _boundary(key)).text(folder).select(F.col("value").cast("binary").alias("raw"))
    parsed = raw.mapInArrow(make_parser(), RECORD_SCHEMA)
    return (parsed.repartition("record", "source_row").sortWithinPartitions("record", "source_row", "chunk")
            .mapInArrow(make_folder_of_chunks(), RESULT_SCHEMA))


# DuckDB SQL: digests and the leader of every payload (base 32 of SHA-1 from eight groups of five hex digits).
_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_GROUP = "CAST('0x' || substr(s, 5 * i + 1, 5) AS BIGINT)"
SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS n FROM pages),
l AS (SELECT s, max(page_id) AS leader FROM p GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i:
    substr({_B32}, CAST(({_GROUP} >> 15) & 31 AS INT) + 1, 1) || substr({_B32}, CAST(({_GROUP} >> 10) & 31 AS INT) + 1, 1)
    || substr({_B32}, CAST(({_GROUP} >> 5) & 31 AS INT) + 1, 1) || substr({_B32}, CAST({_GROUP} & 31 AS INT) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN leader IS NULL OR page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN leader IS NULL OR page_id = leader THEN NULL ELSE leader END AS refers_to
FROM (SELECT p.*, l.leader FROM p JOIN l USING (s))
"""
