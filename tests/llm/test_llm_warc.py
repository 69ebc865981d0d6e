import base64
import gzip
import hashlib
import io

import pytest

from binsight.llm import warc
from binsight.session import scratch_path


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


ROWS = [(3, "http://a.example/é?q=1 2", "same"), (1, "http://b.example/", "same"), (2, None, None), (9, "u", ""),
        (4, "u", "x" * 300_000), (5, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n"), (None, "u", "same"), (1, "http://b.example/", "same"),
        (7, "u", "Ünïcode \x1f 漢字"), (8, "u", "y")]


def expected(rows, least=0):
    first = {}
    for p, _, html in rows:
        b = (html or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(p, first.get(b, p))
    counts = {}
    for _, _, html in rows:
        counts[(html or "").encode()] = counts.get((html or "").encode(), 0) + 1
    out = []
    for p, u, html in rows:
        b = (html or "").encode()
        ref = first.get(b) if len(b) >= least and counts[b] > 1 and p != first.get(b) else None
        out.append((p, u, "response" if ref is None else "revisit", len(b), sha(b), ref))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,split", [(0, 4 << 20), (0, 97), (3, 1000)])
def test_round_trip(spark, least, split):
    pages = spark.createDataFrame([(*r, 0, "z") for r in ROWS], "page_id long, url string, html string, digest int, path string")
    archives = warc.write_archives(warc.classified(pages.repartition(3), least), scratch_path(spark, "w"))
    back = warc.read_archives(spark, archives, split).collect()
    got = sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in back), key=repr)
    assert got == expected(ROWS, least)
    payloads = {r.page_id: bytes(r.payload) for r in back if r.record_type == "response"}
    assert all(sha(payloads[r.page_id]) == r.payload_digest for r in back if r.record_type == "response")
    assert {(r.path, r.offset) for r in back} and len({(r.path, r.offset) for r in back}) == len(ROWS)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(warc.classified(pages), scratch_path(spark, "w"))
    assert warc.read_archives(spark, archives).collect() == []


def test_candidates_are_validated_and_owned_once():
    stray = gzip.compress(b"no record at all") + b"\x1f\x8b\x08 broken"
    parts, starts, raw = [], [], b""
    for i in range(20):
        member = warc.record(i, "u", bytes([i]) * 500, "D", None)
        raw += stray if i % 3 == 0 else b""
        starts.append(len(raw))
        raw += member
    for split in (1, 50, 333, len(raw)):
        found = [at for a in range(0, len(raw), split)
                 for at, _, _ in warc.records(io.BytesIO(raw), a, min(len(raw), a + split), len(raw))]
        assert found == starts, split


def test_a_changed_payload_is_an_error(spark, tmp_path):
    member = warc.record(1, "u", b"payload", sha(b"other"), None)
    (tmp_path / "x.warc.gz").write_bytes(member)
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(member))], "path string, size long")
    with pytest.raises(Exception, match="payload digest differs"):
        warc.read_archives(spark, archives).collect()


def _members(n=6):
    out, at = [], 0
    for i in range(n):
        member = warc.record(i, "u", bytes(range(i, i + 200)) * 3, sha(bytes(range(i, i + 200)) * 3), None)
        out.append((at, member))
        at += len(member)
    return out


@pytest.mark.parametrize("spoil,reason", [(0, "no WARC record"), (14, "no WARC record"), (-6, "damaged")])
def test_a_damaged_member_is_reported_once(spoil, reason):
    members = _members()
    at, member = members[2]
    raw = bytearray(b"".join(m for _, m in members))
    raw[(at if spoil >= 0 else at + len(member)) + spoil] ^= 0xFF
    for split in (1, 50, 333, len(raw)):
        found = [x for a in range(0, len(raw), split)
                 for x in warc.scan(io.BytesIO(bytes(raw)), a, min(len(raw), a + split), len(raw))]
        assert [x[0] for x in found if x[1] is not None] == [a for a, _ in members if a != at], split
        bad = [x for x in found if x[1] is None]
        assert [x[0] for x in bad] == [at] and (reason == bad[0][2] or spoil == 14), split


def test_a_cut_off_file_is_reported():
    members = _members()
    raw = b"".join(m for _, m in members)[:-30]
    for split in (1, 50, 333, len(raw)):
        found = [x for a in range(0, len(raw), split)
                 for x in warc.scan(io.BytesIO(raw), a, min(len(raw), a + split), len(raw))]
        assert [x[0] for x in found] == [a for a, _ in members]
        assert [x[2] for x in found if x[1] is None] == ["cut off"]


def test_damage_fails_or_gives_rows(spark, tmp_path):
    members = _members()
    raw = bytearray(b"".join(m for _, m in members))
    raw[members[3][0] + 60] ^= 0xFF
    (tmp_path / "x.warc.gz").write_bytes(raw)
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(raw))], "path string, size long")
    with pytest.raises(Exception, match=f"x.warc.gz:{members[3][0]}"):
        warc.read_archives(spark, archives).collect()
    rows = warc.read_archives(spark, archives, split_bytes=100, damaged="rows").collect()
    assert sorted(r.page_id for r in rows if r.record_type == "response") == [0, 1, 2, 4, 5]
    assert [(r.offset, r.record_type) for r in rows if r.reason] == [(members[3][0], "damaged")]


def test_ranges_are_dealt_over_tasks(spark):
    pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat(sha2(cast(id as string), 512), 9) as html")
    archives = warc.write_archives(warc.classified(pages), scratch_path(spark, "w"))
    back = warc.read_archives(spark, archives, split_bytes=200)
    assert back.rdd.getNumPartitions() >= min(8, spark.sparkContext.defaultParallelism)
    assert sorted(r.page_id for r in back.collect()) == list(range(40))
