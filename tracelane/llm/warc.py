"""WARC archives without repeated payloads: revisit records point to the first response with the same payload.

Headers, not payloads, are shuffled by payload digest.  Records are written by Spark's text sink, whose line
separator is the end of a record, so archives go wherever Spark can write; they are read back by Spark and parsed
by their Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import SLICE_BYTES, in_arrow, raw, stored

END = "\r\n\r\n"
FILE_BYTES = 32 << 20
"""Archives hold about this much, so that one can be read whole."""
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digested(batches):
    for batch in batches:
        data = [x.as_py() for x in batch.column(2)]
        codes = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in data]
        names = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        yield {**names, "payload_bytes": list(map(len, data)), "payload_digest": codes}


_HEAD = "id long, url string, payload binary, payload_bytes long, payload_digest string"


def _heads(pages: DataFrame, id: str, url: str, payload: str) -> DataFrame:
    table = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), raw(payload).alias("payload"))
    return in_arrow(table, _digested, _HEAD)


def _resolved(heads: DataFrame, least: int) -> DataFrame:
    """Each head with ``record_type``, ``refers_to`` and the response's address ``target``."""
    same = ["payload_digest", "payload_bytes"]
    first = heads.where(F.col("payload_bytes") >= least).groupBy(same)
    first = first.agg(F.count("*").alias("c"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("f"))
    first = first.where("c > 1 and f is not null").select(*same, F.col("f.id").alias("first"), F.col("f.url").alias("target"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return heads.join(first, same, "left").select(
        *heads.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
        F.when(again, F.col("target")).alias("target"),
    )


def _head(value: str) -> str:
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._")


def _records(date: str):
    def work(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {r['payload_bytes']}{END}"
                block = http.encode() + r["payload"]
                lines = [
                    "WARC/1.1",
                    f"WARC-Type: {r['record_type']}",
                    f"WARC-Record-ID: <urn:page:{'' if r['id'] is None else r['id']}>",
                    f"WARC-Date: {date}",
                    f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                    f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
                    "Content-Type: application/http; msgtype=response",
                ]
                if r["url"] is not None:
                    lines.append(f"WARC-Target-URI: {_head(r['url'])}")
                if r["record_type"] == "revisit":
                    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{r['refers_to']}>"]
                    if r["target"] is not None:
                        lines.append(f"WARC-Refers-To-Target-URI: {_head(r['target'])}")
                lines.append(f"Content-Length: {len(block)}")
                out.append("\r\n".join(lines).encode() + END.encode() + block)
            yield {"value": out}

    return work


def write(
    pages: DataFrame,
    path: str,
    date: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 0,
) -> None:
    """Write one record per row of ``pages`` to gzipped WARC files below ``path``; ``date`` is their WARC-Date.

    Of the rows with an equal payload (null: empty) of at least ``least`` bytes, those with the smallest id are
    responses and the others revisits that refer to it; rows with smaller payloads are all responses.  Responses
    carry an HTTP header and the payload; revisits the HTTP header alone, with the payload's length in it, and its
    digest, the response's id and its address.

    Only headers are grouped and joined by digest: counted before the join, whose hot keys AQE splits.  Revisits are
    written from their headers; the payloads of responses meet the list of revisits by (id, digest).

    A null id is never referred to; alone with its payload it is a response.  Letters that a header can't hold are
    percent-encoded, null addresses left out.  Rows repeated whole with the smallest id are responses each.  An empty
    table gives no record.
    """
    whole = _heads(pages, id, url, payload)
    found = stored(_resolved(whole.drop("payload"), least))
    total, rows = found.agg(F.sum("payload_bytes"), F.count("*")).first()
    again = found.where("record_type = 'revisit'")
    gone = again.select(F.col("id").alias("own"), F.col("payload_digest").alias("code")).distinct()
    rest = whole.join(gone, F.col("id").eqNullSafe(F.col("own")) & (F.col("payload_digest") == F.col("code")), "left_anti")
    nothing = F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("target")
    responses = rest.select("*", F.lit("response").alias("record_type"), *nothing)
    revisits = again.select("id", "url", F.lit(b"").alias("payload"), *responses.columns[3:])
    records = in_arrow(responses.union(revisits), _records(date), "value binary")
    records = records.select(F.col("value").cast("string").alias("value"))
    most = max(1, FILE_BYTES * rows // (total + 1000 * rows)) if rows else 1
    writer = records.write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", most).text(path)


def records(data: bytes):
    """The records of an uncompressed archive: headers by lower-case name, and the block."""
    at = 0
    while at < len(data):
        stop = data.index(END.encode(), at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        begin = stop + len(END)
        end = begin + int(headers["content-length"])
        if data[end : end + len(END)] != END.encode():
            raise ValueError(f"the record at byte {at} has no end")
        yield headers, data[begin:end]
        at = end + len(END)


_PAGE = re.compile(r"<urn:page:(-?\d*)>")


def _parsed(batches):
    for batch in batches:
        for content in batch.column(0):
            out = {k: [] for k in ("id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")}
            held = 0
            for headers, block in records(gzip.decompress(content.as_py())):
                http, payload = block.split(END.encode(), 1)
                size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response":
                    if size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{headers['warc-record-id']}: the payload is damaged")
                page = _PAGE.fullmatch(headers["warc-record-id"])[1]
                to = _PAGE.fullmatch(headers.get("warc-refers-to", "<urn:page:>"))[1]
                row = (page and int(page) or (0 if page else None), headers.get("warc-target-uri"), headers["warc-type"])
                row += (int(to) if to else None, size, digest, payload if headers["warc-type"] == "response" else None)
                for column, value in zip(out.values(), row):
                    column.append(value)
                held += len(payload)
                if held > SLICE_BYTES:
                    yield out
                    out, held = {k: [] for k in out}, 0
            yield out


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` per record below ``path``.

    Every response's payload is checked against its digest; a revisit's payload is null.  An archive is parsed whole
    in one task; ``write`` keeps it at about ``FILE_BYTES``.  An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    )
    schema = (
        "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "payload binary"
    )
    content = files.option("pathGlobFilter", "part-*").load(path).select("content")
    return in_arrow(content, _parsed, schema).withColumnRenamed("id", "page_id")
