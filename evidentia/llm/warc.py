"""WARC archives: a writer with revisit records, and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship, written
from .common import pick

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
SPLIT_BYTES = 16 << 20
#: A file is closed when it has grown to this size, so that its size has a bound.
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 18
#: Payload bytes of a batch that the reader hands over.
HELD_BYTES = 8 << 20
#: Compressed bytes that are inflated at a time.
INFLATE_BYTES = 1 << 13
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes long, payload binary, verified boolean, path string, offset long"
)


def _filesystem(uri: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _member(head: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = head | {"Content-Length": str(len(block))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(url: str | None) -> str:
    """A header value cannot hold line breaks."""
    return re.sub(r"[\r\n]+", " ", url or "").strip()


def _records(frame: pd.DataFrame) -> Iterator[bytes]:
    for row in frame.itertuples(index=False):
        size, digest = int(row.n_bytes), base64.b32encode(bytes.fromhex(row.sha1)).decode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        head = {
            "WARC-Type": "response" if row.is_response else "revisit",
            "WARC-Record-ID": f"<urn:record:{row.record_id}>",
            "WARC-Target-URI": _uri(row.url),
            "WARC-Date": "2024-01-01T00:00:00Z",
            "Content-Type": "application/http; msgtype=response",
            "WARC-Payload-Digest": f"sha1:{digest}",
        }
        if row.is_response:
            yield _member(head, http + bytes(row.payload or b""))
        else:
            head |= {"WARC-Refers-To": f"<urn:record:{row.response_id}>", "WARC-Profile": PROFILE}
            yield _member(head, http)


def _writer(folder: str, file_bytes: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(folder)
        out, path, size, count = None, "", 0, 0
        for frame in frames:
            for member in _records(frame):
                if out is None:
                    # Each attempt has names of its own; only files in the manifest count.
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    yield pd.DataFrame([[path, size, count]], columns=["path", "bytes", "records"])
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame([[path, size, count]], columns=["path", "bytes", "records"])

    return write


def with_responses(pages: DataFrame, id_col: str, url_col: str, body_col: str, min_bytes: int) -> DataFrame:
    """Rows with digest and the identifier of the record that holds the payload; responses have their payload.

    Payloads move once, and only to the record that keeps them: a digest's copies meet the group's identifier without
    their payloads, between two exchanges, so that a payload that a third of all pages share can be split.
    """
    rows = pick(pages, {id_col: "long", url_col: "string", body_col: "string"})
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = rows.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload"),
        F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n_bytes"), F.xxhash64(body).alias("verify"),
    )
    key = ["sha1", "n_bytes", "verify"]
    digests = written(rows.drop("payload"), "warc-digests")
    shared = F.col("n_bytes") >= min_bytes
    groups = digests.where(shared).groupBy(*key).agg(F.max("id").alias("best"))
    groups = written(groups.withColumn("best_id", _id_text("best")), "warc-groups")
    # The identifier is part of this key, so no payload is hot.
    kept = groups.select(*key, F.col("best_id").alias("record_id"))
    held = rows.withColumn("record_id", _id_text("id"))
    first = held.where(shared).join(kept, [*key, "record_id"], "left_semi").unionByName(held.where(~shared))
    again = digests.where(shared).join(groups, key).where(_id_text("id") != F.col("best_id"))
    first = first.select("record_id", F.col("record_id").alias("response_id"), "url", "sha1", "n_bytes", F.lit(True).alias("is_response"), "payload")
    again = again.select(
        _id_text("id").alias("record_id"), F.col("best_id").alias("response_id"), "url", "sha1", "n_bytes",
        F.lit(False).alias("is_response"), F.lit(None).cast("binary").alias("payload"),
    )
    return first.unionByName(again)


def _id_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row below `folder`, and return the manifest (path, bytes, records) as a written table.

    Of the rows whose payloads are equal and at least `min_bytes` long, the one with the largest id becomes a
    `response` record with the payload; the others become `revisit` records that refer to it. Smaller payloads are
    all responses. Files of failed or repeated attempts are not in the manifest and are never read.

    Defined cases: a null body is an empty payload; a null id is written as `null` and comes before all others;
    rows that repeat the largest id and its payload are all responses; line breaks in a URL become spaces; an empty
    table writes no file and gives an empty manifest; further columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    system, root = _filesystem(folder)
    system.create_dir(f"{root}/records", recursive=True)
    rows = with_responses(pages, id_col, url_col, body_col, min_bytes)
    manifest = rows.mapInPandas(_writer(f"{folder}/records", file_bytes), MANIFEST)
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ("file:" if folder.startswith("file:") else "")
    if scheme and not scheme.startswith("file"):
        manifest = manifest.withColumn("path", F.concat(F.lit(scheme), "path"))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Window:
    """A file read forward in pieces, of which only the unread end stays in memory."""

    def __init__(self, source, start: int, size: int) -> None:
        self.source, self.at, self.size, self.data = source, start, size, bytearray()
        source.seek(start)

    def more(self) -> bool:
        piece = self.source.read(min(READ_BYTES, self.size - self.at - len(self.data)))
        self.data += piece
        return bool(piece)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _decode(window: _Window) -> tuple[bytes, int] | None:
    """The record of the member at the window's start and the member's length; None if there is no such member.

    A candidate counts only if it inflates and begins with a WARC version line; magic bytes inside compressed data
    fail this at once. The window keeps the bytes from the member's start.
    """
    unpack, record, fed = zlib.decompressobj(31), bytearray(), 0
    while not unpack.eof:
        if fed == len(window.data) and not window.more():
            return None
        piece = bytes(window.data[fed : fed + INFLATE_BYTES])
        try:
            record += unpack.decompress(piece)
        except zlib.error:
            return None
        fed += len(piece)
        if not record.startswith(VERSION) and (len(record) >= len(VERSION) or unpack.eof):
            return None
    return bytes(record), fed - len(unpack.unused_data)


def members(source, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Records whose member starts in [start, stop), each with its offset; the last may end beyond `stop`."""
    window = _Window(source, start, size)
    while window.at < stop:
        found = window.data.find(MAGIC)
        if found < 0:
            window.drop(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.drop(found)
        if window.at >= stop:
            return
        record = _decode(window)
        if record is None:
            window.drop(1)
            continue
        yield window.at, record[0]
        window.drop(record[1])


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record; the payload's digest is computed anew where the record holds it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, payload = "", block
    if fields.get("content-type", "").startswith("application/http"):
        raw, _, payload = block.partition(b"\r\n\r\n")
        http = raw.decode("latin-1")
    urn = lambda name: re.sub(r"^<urn:record:(.*)>$", r"\1", fields[name]) if name in fields else None
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    stated = re.search(r"(?im)^content-length:\s*(\d+)", http)
    size, verified = (int(stated[1]) if stated else None), None
    if kind == "response":
        computed = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        verified = digest is None or computed == digest
        digest, size = computed, len(payload)
    return {
        "record_id": urn("warc-record-id"), "record_type": kind, "refers_to": urn("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size,
        "payload": payload if kind == "response" else None, "verified": verified,
    }


def _reader(with_payload: bool):
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                system, path = _filesystem(row.path)
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for offset, record in members(source, int(row.bytes), int(row.start), int(row.stop)):
                        one = parse_record(record) | {"path": row.path, "offset": offset}
                        if not with_payload:
                            one["payload"] = None
                        rows.append(one)
                        held += len(one["payload"] or b"") + 200
                        if held > HELD_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return read


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the files in `manifest` (path, bytes), read by byte ranges that are dealt over the cluster.

    A range begins anywhere: its task looks for gzip magic, accepts a candidate only if it decodes to a WARC header,
    and owns the records that start inside the range, reading past its end to finish the last one. Damaged members
    are passed over. An empty manifest gives no rows; further columns are ignored.
    """
    spark: SparkSession = manifest.sparkSession
    ship(spark)
    ranges = pick(manifest, {"path": "string", "bytes": "long"}).where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    )
    ranges = ranges.withColumn("stop", F.least(F.col("start") + split_bytes, F.col("bytes")))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, "path", "start").mapInPandas(_reader(with_payload), RECORDS)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back (payloads stay in the archives)."""
    manifest = write_warc(pages, scratch_path(pages.sparkSession, "warc"), min_bytes=min_bytes)
    return read_warc(manifest, with_payload=False)


def base32_of_hex(value: str) -> str:
    """The bare upper-case base32 form of a hexadecimal digest."""
    return base64.b32encode(binascii.unhexlify(value)).decode()
