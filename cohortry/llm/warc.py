"""WARC archives: writing, normalising of monolithic gzip files, and reading by offset.

Pages are written as whole-file gzip streams, many records to a stream, the form in which a reader must inflate
everything before the record it wants.  The normaliser inflates such a file once, as a stream, rewrites every record
as a gzip member of its own and writes a sidecar index of offsets beside it.  Reading back inflates single members
at their offsets.

Files live in the shared folder and are opened through a file system that follows the folder's URI.  Every attempt
of a task writes files of its own, and only those that the written index names are read, so lost executors and
repeated tasks do no harm.  Tasks hold one record at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import col, durable, fresh_path

LEAST_BYTES = 1000           # payloads from this size on are stored once
CHUNK = 1 << 18
ROLL = 256 << 20             # uncompressed bytes in a file before the next one begins
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PAGE = ("page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
        "refers_to string")


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _line(value) -> str:
    """A header value: line ends cannot stand in a header."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def _urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _from_urn(urn: str | None) -> str | None:
    return None if urn in (None, "<urn:page>") else unquote(urn.removeprefix("<urn:page:").removesuffix(">"))


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record.  A revisit carries the headers of its payload, not the payload."""
    head = HTTP % len(payload)
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_line(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:60]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return fields, rest[:int(fields["content-length"])]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time; a stream that ends inside a record is an error."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None and (at := held.find(b"\r\n\r\n")) >= 0:
                fields = {k.strip().lower(): v for k, _, v in (x.partition(b":") for x in bytes(held[:at]).split(b"\r\n")[1:])}
                need = at + 4 + int(fields[b"content-length"]) + 4
            if need is None or len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"the stream ends inside a record; {len(held)} bytes are left")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in chunks of bounded size."""
    engine = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            if engine.eof:
                engine = zlib.decompressobj(31)
            yield engine.decompress(chunk, CHUNK * 4)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, CHUNK * 4)
            chunk = engine.unused_data if engine.eof else b""
    if not engine.eof:
        raise ValueError("the gzip stream is cut off")


def write_monolithic(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` (page_id, url, payload) to gzip files of one stream each; returns their paths, written down.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response
    and the others refer to it; rows that share that page_id are all responses.  Null ids rank below all others.
    """
    rows = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    copies = (rows.where(F.col("size") >= least_bytes).groupBy("digest", "size")
              .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # Only payloads that repeat are looked up, so what moves is a digest per such payload where that is small.
    sent = rows.join(durable(copies, "copies"), ["digest", "size"], "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).cast("string").alias("refers_to"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, paths, raw = None, [], 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    name = f"{uuid.uuid4().hex}.mono.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    engine, raw = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                    paths.append(f"{folder}/{name}")
                record = record_bytes(row.page_id, row.url, row.payload, row.digest, row.refers_to)
                raw += len(record)
                out.write(engine.compress(record))
                if raw >= roll:
                    out.write(engine.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
        yield pd.DataFrame({"path": paths}, dtype="object")

    return durable(sent.mapInPandas(write, "path string"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each gzip file (column path) with a member per record; returns the written index.

    Index rows: file, offset, length (of the member), record_id, record_type.  The same index lies beside each
    file as ``<file>.idx``, one JSON line per record.
    """
    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for frame in frames for p in frame["path"]):
            system, at = _open(path)
            target, root = _open(folder)
            target.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.gz"
            rows, offset = [], 0
            with (system.open_input_stream(at, compression=None) as stream,
                  target.open_output_stream(f"{root}/{name}", compression=None) as out,
                  target.open_output_stream(f"{root}/{name}.idx", compression=None) as sidecar):
                for record in records_of(inflated(stream)):
                    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = engine.compress(record) + engine.flush()
                    out.write(member)
                    fields, _ = parse_record(record)
                    row = {"file": f"{folder}/{name}", "offset": offset, "length": len(member),
                           "record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"]}
                    sidecar.write((json.dumps(row) + "\n").encode())
                    rows.append(row)
                    offset += len(member)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows)
                        rows = []
            if rows:
                yield pd.DataFrame(rows)

    # One file per task: files are large, and there are few of them.
    return durable(archives.repartition(max(1, min(archives.count(), 100_000))).mapInPandas(
        rewrite, "file string, offset long, length long, record_id string, record_type string"), "index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, each inflated alone: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to; ids are texts, as in the files.  A payload that does not have its
    recorded digest is an error."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, source = None, None
        for frame in frames:
            rows, size = [], 0
            for entry in frame.itertuples(index=False):
                if entry.file != held:
                    if source is not None:
                        source.close()
                    system, at = _open(entry.file)
                    held, source = entry.file, system.open_input_file(at)
                source.seek(entry.offset)
                fields, block = parse_record(zlib.decompress(source.read(entry.length), 31))
                revisit = fields["warc-type"] == "revisit"
                payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{entry.file} at {entry.offset}: the payload does not have its digest")
                rows.append((_from_urn(fields["warc-record-id"]), fields.get("warc-target-uri"), payload,
                             int(fields["warc-payload-length"]), digest, fields["warc-type"], _from_urn(fields.get("warc-refers-to"))))
                size += len(payload or b"")
                if size > 32 << 20:
                    yield _frame(rows)
                    rows, size = [], 0
            if rows:
                yield _frame(rows)
        if source is not None:
            source.close()

    return index.mapInPandas(read, PAGE)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PAGE.split(", ")], dtype="object")


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Write every row as a WARC record, normalise the archives and read them back, one row per input row.

    The payload is the text in UTF-8, null counting as empty.  Columns as in :func:`read_records`.  Null ids, null
    urls and repeated rows come back as they went in; other columns are not touched; an empty table gives no
    archive and no row.
    """
    spark: SparkSession = df.sparkSession
    folder = folder or fresh_path(spark, "warc")
    pages = df.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"),
                      F.coalesce(col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    index = normalise(write_monolithic(pages, f"{folder}/monolithic", least_bytes), folder)
    system, root = _open(f"{folder}/monolithic")      # every record has its member by now
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)
    kind = pages.schema["page_id"].dataType
    return read_records(index).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}
                                           ).withColumnRenamed("page_id", id_col)
