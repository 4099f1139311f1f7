"""WARC archives of pages: an index first, then coalesced byte-range reads of the records it selects."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, new_path, text_of, written

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 28
#: Ranges of one read may lie this far apart; a read is at most READ_BYTES long, or one record.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
#: Index rows are dealt to readers by stretches of an archive of this length.
STRETCH_BYTES = 1 << 25
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id {id}, url string, payload_digest string, record_type string, payload_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """text as the value of one header line: line ends would end it early."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One gzip member: a response with HTTP header and payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []), f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, body) of one gzip member."""
    plain = gzip.decompress(raw)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


def write(pages: DataFrame, where: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to archives below `where`; returns the index, written.

    Of the pages whose payloads (html in UTF-8, null as empty) are equal and have min_bytes or more, those with the
    largest page_id are responses and the others revisit it; smaller payloads are all responses. Each task names its
    archives for its partition and attempt, and only the index rows of the attempt that counts are kept, so a lost or
    repeated task leaves at most files to which nothing points. `where` may be any file system that Arrow opens.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    source = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    groups = source.groupBy("sha").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("pages"))
    groups = written(groups, "payloads")
    total = groups.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    small = F.octet_length("html") < min_bytes
    marked = join_groups(source, groups, ["sha"], "pages", total).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("newest")) & ~small, F.col("newest")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        task = TaskContext.get()
        files, root = FileSystem.from_uri(where)
        number, out, path, at = 0, None, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    files.create_dir(root, recursive=True)
                    out, path, at, number = files.open_output_stream(f"{root}/{name}", compression=None), name, 0, number + 1
                payload = html.encode()
                digest = base32_sha1(payload)
                raw = record(page_id, url, payload, digest, refers_to, date)
                out.write(raw)
                rows.append((f"{where}/{path}", at, len(raw), None if page_id is None else int(page_id), url, digest, "response" if refers_to is None else "revisit", len(payload)))
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pd.DataFrame(rows, columns=["archive", "offset", "length", "page_id", "url", "payload_digest", "record_type", "payload_bytes"]).astype({"page_id": object})
        if out is not None:
            out.close()

    # ids as text: pandas would turn integers beside nulls into floats
    marked = marked.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return written(marked.mapInPandas(run, INDEX.format(id=id_type)), "index")


def read(index: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, html of the records that index rows select.

    Rows are sorted by archive and offset; neighbouring ranges are read at once. A response whose payload does not
    have the digest of its header, or that the index gives otherwise, fails the job. html is null for a revisit.
    """
    id_type = index.schema["page_id"].dataType.simpleString()
    columns = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            spans: list[list] = []
            for archive, offset, length, digest in zip(batch["archive"], batch["offset"], batch["length"], batch["payload_digest"], strict=True):
                end = offset + length
                if spans and spans[-1][0] == archive and offset <= spans[-1][2] + GAP_BYTES and end - spans[-1][1] <= READ_BYTES:
                    spans[-1][2] = max(spans[-1][2], end)
                    spans[-1][3].append((offset, length, digest))
                else:
                    spans.append([archive, offset, end, [(offset, length, digest)]])
            opened, file = None, None
            for archive, start, end, wanted in spans:
                if archive != opened:
                    files, path = FileSystem.from_uri(archive)
                    opened, file = archive, files.open_input_file(path)
                raw = file.read_at(end - start, start)
                rows = []
                for offset, length, digest in wanted:
                    fields, http, body = parse(raw[offset - start : offset - start + length])
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if stated != digest or response and base32_sha1(body) != stated:
                        raise ValueError(f"{archive} at {offset}: the payload's digest differs")
                    page, refers = (None if fields.get(x) is None else int(fields[x]) for x in ("X-Page", "X-Refers-To-Page"))
                    rows.append((page, fields.get("WARC-Target-URI"), fields["WARC-Type"], stated, int(http["Content-Length"]), refers, body.decode() if response else None))
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": object, "refers_to": object})

    ranges = index.select("archive", "offset", "length", "payload_digest", F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch"))
    ranges = ranges.repartition("archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    schema = f"page_id {id_type}, url string, record_type string, payload_digest string, payload_bytes long, refers_to {id_type}, html string"
    return ranges.mapInPandas(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of `pages` as `read` gives them after `write` to archives in the shared folder.

    Null html counts as empty, a null url is left out of the record, a page without an id is a revisit where an equal
    payload has an id and a response otherwise. Repeated rows each give a record; of rows that repeat with the largest
    id, each is a response. An empty table gives an empty result. Other columns are ignored. Ids are integers.
    """
    return read(write(pages, new_path(pages.sparkSession, "warc"), min_bytes))
