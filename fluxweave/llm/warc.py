"""WARC archives with a Zstandard dictionary: writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then has one Zstandard frame for
each record, so any record can be read alone. Archives and their list are written into the shared folder; only files named
by a committed row of the list are read, so what a lost or repeated task leaves behind is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialise, scratch_path

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is built from so many whole records at most (those with the smallest hashed page_id), and so many bytes of them.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 32 << 20, 65_536
LEVEL = 3
ROLL_BYTES = 1 << 30
CHUNK = 1 << 17

_LIST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sampled records; empty where they are too few or too short to make one."""
    samples = [x for x in samples if x]
    if sum(map(len, samples)) < 8 * 256 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A WARC/1.1 record: a revisit of page `first`, or a response if that is null or the page itself."""
    revisit = first is not None and first != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page", str(first)), ("X-Payload-Bytes", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    if url is None:
        head.append(("X-No-URL", "1"))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict | None:
    """A record's fields; None for records that are neither response nor revisit."""
    cut = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:cut].decode().split("\r\n")[1:])
    if head["WARC-Type"] not in ("response", "revisit"):
        return None
    block = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    page, first, digest = head.get("X-Page"), head.get("X-Refers-To-Page"), head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and digest32(payload) != digest:
        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't match its digest")
    return {"page_id": int(page) if page else None, "url": None if "X-No-URL" in head else head["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": int(head["X-Payload-Bytes"]) if revisit else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(first) if revisit else None}


class Archive:
    """One archive being written."""

    def __init__(self, folder: str, dictionary: bytes) -> None:
        self.path, self.n_records, self.n_bytes = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        if dictionary:
            self._write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        about = b"software: fluxweave\r\nformat: WARC File Format 1.1\r\n"
        self._write(self.zip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n".encode() + about + b"\r\n\r\n"))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def add(self, raw: bytes) -> None:
        self._write(self.zip.compress(raw))
        self.n_records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.n_records, self.n_bytes


def _writer(folder: str, dictionary: bytes, roll: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            for page_id, url, payload, first in zip(*batch.columns, strict=True):
                archive = archive or Archive(folder, dictionary)
                archive.add(record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py()))
                if archive.n_bytes >= roll:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], schema=_LIST)

    return run


def records_in(stream) -> Iterator[bytes]:
    """The records of an open archive, one after another; memory holds a chunk and a record."""
    head, dictionary = stream.read(8), b""
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        dictionary, head = stream.read(struct.unpack("<II", head)[1]), b""
    unzip = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    rest = head
    while rest := rest or stream.read(CHUNK):
        frame, parts = unzip.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := stream.read(CHUNK)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def _reader(with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for raw in records_in(stream):
                        if found := parse(raw):
                            held += len(raw) if with_payload else 200
                            rows.append(found if with_payload else found | {"payload": None})
                            if held >= 16 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                                rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


def sampled_records(rows: DataFrame, n: int = SAMPLE_RECORDS, n_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """Whole records, as they are archived, of a bounded sample of rows(page_id, url, payload, first): those with the smallest hashed
    page_id, n at most, of which one that would take the sum of their payloads past n_bytes is left out. Sizes are looked at first,
    so that the driver never gets more than that."""
    sized = hashed_sample(rows.select("page_id", F.octet_length("payload").alias("size")), "page_id", n, F.col("page_id"), F.col("size")).collect()
    picked, held = [], 0
    for r in sorted(sized, key=lambda r: (r["h"], r["size"])):
        if r["page_id"] is not None and held + r["size"] <= n_bytes:
            held += r["size"]
            picked.append(f"{r['page_id']}:{r['size']}")
    if not picked:
        return []
    told = F.concat_ws(":", "page_id", F.octet_length("payload"))
    found = rows.filter(told.isin(picked)).withColumn("told", told).dropDuplicates(["told"]).collect()
    return [record(r["page_id"], r["url"], bytes(r["payload"]), r["first"]) for r in sorted(found, key=lambda r: (r["page_id"], r["told"]))]


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html, ...) and returns (path, n_records, n_bytes) of the archives.

    The payload is the html in UTF-8, null being empty. Of records with equal payloads of min_revisit_bytes at least, the
    one with the smallest page_id is a response and the others are revisits of it; smaller ones are all responses. Rows
    that repeat the smallest page_id are all responses, and so is a row whose equals all have a null page_id; a null page_id
    is never the smallest otherwise. A null url is kept as null. Other columns are not read. No row, no archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("sha"), F.octet_length(payload).alias("n"))
    groups = keyed.filter(F.col("n") >= min_revisit_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("sha", "n", "first")
    groups = materialise(groups, "warc-groups")  # plain on both sides, the join can split a very common payload
    rows = keyed.join(groups, ["sha", "n"], "left").select("page_id", "url", "payload", "first")
    dictionary = train(sampled_records(rows))
    folder = folder or scratch_path(spark, "warc")
    return materialise(rows.mapInArrow(_writer(folder, dictionary, ROLL_BYTES), "path string, n_records long, n_bytes long"), "warc-list")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of each record.

    Every response's payload is held against its digest; a mismatch or an archive cut short is an error.
    """
    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInArrow(_reader(with_payload), _READ_DDL)
