"""WARC archives written and read by Spark tasks, always through an index.

The index has a row per record: file, offset, length, URL and payload digest. Readers choose
index rows first; tasks then read the chosen records in merged byte ranges, sorted by place.
Files go through ``pyarrow.fs``, so the folder may be any shared store it can open. A file's
name is new for every attempt, and the index lists only files of attempts that succeeded.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.skew import per_key
from gondola.session import scratch_path, stage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id long, url string, file string, offset long, length long, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def with_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Decide per page whether it is a response or a revisit of the smallest id with that payload.

    Pages with payloads under ``min_revisit_bytes`` are all responses. Rows that share the
    smallest id are all responses, as are equal payloads of which none has an id.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    known = rows.join(per_key(firsts, "digest"), "digest")
    revisit = (
        (F.octet_length("payload") >= min_revisit_bytes)
        & F.col("first").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("first"))
    )
    return known.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))


def _record_id(archive: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{page_id}')}>"


def _member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record, as a gzip member of its own so that it can be read alone."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    record = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _page_record(archive: str, date: str, page_id, url, payload: bytes, refers_to) -> tuple[bytes, str]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(archive, page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url and CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(archive, refers_to) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _member(fields, http.encode() + (b"" if revisit else payload)), digest


def write_archive(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, max_file_bytes: int = 256 << 20
) -> DataFrame:
    """Write a record per page below ``folder``; return the stored index.

    Null pages are empty, null URLs have no target line, control characters in URLs are
    percent-encoded in the record only. Further columns of ``pages`` are not read.
    """
    date = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink, rows, name, at = None, [], "", 0

        def finished() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    sink, rows = store.open_output_stream(f"{root}/{name}", compression=None), []
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(folder, None)), ("WARC-Date", date)]
                    first = _member([*info, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    sink.write(first)
                    at = len(first)
                payload = payload.encode()
                record, digest = _page_record(folder, date, page_id, url, payload, refers_to)
                sink.write(record)
                kind = "response" if refers_to is None else "revisit"
                rows.append((page_id, url, name, at, len(record), digest, len(payload), kind, refers_to))
                at += len(record)
                if at >= max_file_bytes:
                    sink.close()
                    sink = None
                    yield finished()
        if sink is not None:
            sink.close()
            yield finished()

    kinds = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
            ("length", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("record_type", pa.string()), ("refers_to", pa.int64()),
        ]
    )
    return stage(with_records(pages, min_revisit_bytes).mapInArrow(run, INDEX), "warc-index")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if "application/http" in fields["content-type"] else block


def merged_ranges(
    places: list[tuple[int, int]], gap: int, most: int
) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, length, numbers of the places inside) over sorted places; gaps up to ``gap`` are read along."""
    first = end = 0
    inside: list[int] = []
    for number, (offset, length) in enumerate(places):
        if inside and (offset > end + gap or max(end, offset + length) - first > most):
            yield first, end - first, inside
            inside = []
        if not inside:
            first = end = offset
        inside.append(number)
        end = max(end, offset + length)
    if inside:
        yield first, end - first, inside


def read_records(
    index: DataFrame,
    folder: str,
    gap: int = 64 << 10,
    most: int = 8 << 20,
    stretch: int = 16 << 20,
    with_payload: bool = True,
) -> DataFrame:
    """Read the records that the rows of ``index`` name, checked against their digests.

    A file is dealt out in stretches of ``stretch`` bytes, so one large file is many tasks;
    a task reads merged ranges of at most ``most`` bytes (a longer record alone is longer).
    ``payload`` is null for revisits. A record that does not match its digest is an error.
    """
    schema = (
        "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
        "refers_to long" + (", payload string" if with_payload else "")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for name, rows in frame.groupby("file", sort=False):
                with store.open_input_file(f"{root}/{name}") as source:
                    places = list(zip(rows["offset"].tolist(), rows["length"].tolist()))
                    for start, length, inside in merged_ranges(places, gap, most):
                        source.seek(start)
                        data = source.read(length)
                        yield pd.DataFrame(
                            [read(rows.iloc[k], data, places[k][0] - start, places[k][1]) for k in inside],
                            columns=names,
                        ).astype({"page_id": "Int64", "refers_to": "Int64"})

    def read(row, data: bytes, at: int, length: int) -> tuple:
        fields, payload = parse_record(zlib.decompress(data[at : at + length], 31))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        response = fields["warc-type"] == "response"
        if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record of page {row['page_id']} does not match its digest")
        n = len(payload) if response else row["payload_bytes"]
        found = (row["page_id"], row["url"], fields["warc-type"], digest, n, row["refers_to"])
        return (*found, payload.decode() if response else None) if with_payload else found

    names = [f.split()[0] for f in schema.split(", ")]
    where = index.withColumn("stretch", (F.col("offset") / stretch).cast("long"))
    chosen = where.repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return chosen.drop("stretch").mapInPandas(run, schema)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
