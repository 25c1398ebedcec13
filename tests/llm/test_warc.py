from __future__ import annotations

import base64
import hashlib
import io
import random
import struct
from collections import Counter

import pytest
import zstandard

from fluxweave.llm import warc


@pytest.fixture(scope="module")
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha string, payload string")


def body(k):
    return f"<html><head><title>page {k % 40}</title></head><body>" + " ".join(f"<p>line {k % 40} of {j}</p>" for j in range(30)) + "</body></html>"


def brute(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x for x in groups[b] if x is not None), default=None)
        revisit = len(b) >= least and first is not None and first != i
        out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


ROWS = [(k, f"http://h/{k}", body(k)) for k in range(150)] + [(500, None, None), (501, "http://x/\r\nX: y", ""), (502, "", "é" * 50_000), (None, "u", body(3)), (None, "u", "lone"), (7, "again", body(7)), (503, "k", "\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip_matches_brute_force(pages_of, least):
    archives = warc.write_archives(pages_of(ROWS), min_revisit_bytes=least)
    read = warc.read_archives(archives).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read) == brute(ROWS, least)
    sent = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert all((r.page_id, bytes(r.payload)) in sent for r in read if r.record_type == "response")
    assert sum(r.n_records for r in archives.collect()) == len(ROWS)


def test_layout_is_a_skippable_dictionary_then_single_frames(spark, pages_of):
    path = warc.write_archives(pages_of(ROWS).coalesce(1)).first().path
    raw = open(path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8:12] == struct.pack("<I", 0xEC30A437)
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    at, n = 8 + size, 0
    while at < len(raw):
        one = unzip.decompressobj()
        text = one.decompress(raw[at:])
        assert one.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        at, n = len(raw) - len(one.unused_data), n + 1
    assert n >= 2
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(raw[8 + size :])


def test_dictionary_helps(tmp_path):
    rng = random.Random(2)
    samples = [body(rng.randrange(40)).encode() for _ in range(300)]
    one = warc.Archive(f"file://{tmp_path}", warc.train(samples))
    none = warc.Archive(f"file://{tmp_path}", b"")
    for k in range(50):
        for a in (one, none):
            a.add(warc.record(k, "u", body(k).encode(), None))
    head = len(warc.train(samples))
    a, b = one.close(), none.close()
    assert a[2] - head < b[2]
    assert [warc.parse(r)["page_id"] for r in warc.records_in(open(b[0].removeprefix("file://"), "rb")) if warc.parse(r)] == list(range(50))


def test_damage_is_an_error(tmp_path):
    raw = warc.record(1, "u", b"hello", None).replace(b"hello", b"hellO")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw)
    whole = zstandard.ZstdCompressor().compress(b"x" * 1000)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_in(io.BytesIO(whole[:-3])))


def test_few_samples_give_no_dictionary_and_empty_tables(spark, pages_of):
    assert warc.train([]) == b"" and warc.train([b"abc"] * 3) == b""
    archives = warc.write_archives(pages_of(ROWS).limit(0))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0
    small = warc.write_archives(pages_of([(1, "u", "tiny")]))
    assert [bytes(r.payload) for r in warc.read_archives(small).collect()] == [b"tiny"]


def test_the_dictionary_is_made_of_whole_archived_records(spark):
    rows = [(i, f"http://x.org/{i}", bytearray(b"<p>page %d</p>" % i * (1 + i)), 3 if i == 7 else None) for i in range(20)]
    found = warc.sampled_records(spark.createDataFrame(rows, "page_id long, url string, payload binary, first long"))
    assert found == [warc.record(i, u, bytes(p), f) for i, u, p, f in rows] and b"WARC-Refers-To" in found[7]
    few = warc.sampled_records(spark.createDataFrame(rows, "page_id long, url string, payload binary, first long"), n_bytes=300)
    assert few and sum(len(warc.parse(r)["payload"] or b"") for r in few) <= 300 and set(few) < set(found)
    assert warc.sampled_records(spark.createDataFrame(rows[:0], "page_id long, url string, payload binary, first long")) == []
