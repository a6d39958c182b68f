import base64
import gzip
import hashlib
import io
import random

import duckdb
import pytest

from tessera.llm import warc as W


def rec(i, body=b"<html>" + b"x" * 120, refers=None):
    return W.record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), refers)


def ids(found):
    return [x["page_id"] for x in found if x["kind"] == "record"]


def gaps(found):
    return [(x["offset"], x["length"]) for x in found if x["kind"] == "gap"]


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress], ids=["plain", "gzip"])
def test_damage_loses_only_what_it_hits(pack):
    parts = [pack(rec(i, b"%d" % i * 200)) for i in range(6)]
    at = [sum(map(len, parts[:k])) for k in range(7)]
    whole = b"".join(parts)
    assert ids(W.salvage(whole)) == list(range(6)) and gaps(W.salvage(whole)) == []
    for where in (at[2] + 1, at[3] - 24, at[3] - 7):  # version line or magic, payload or deflated data, CRC or framing
        bad = bytearray(whole)
        bad[where] ^= 0xFF
        found = list(W.salvage(bytes(bad)))
        assert ids(found) == [0, 1, 3, 4, 5] and gaps(found) == [(at[2], at[3] - at[2])]
    found = list(W.salvage(whole[: at[3] - 9] + whole[at[3] :]))
    assert ids(found) == [0, 1, 3, 4, 5] and len(gaps(found)) == 1
    found = list(W.salvage(b"junk" + whole + b"\x1f\x8b\x08trailing"))
    assert ids(found) == list(range(6)) and gaps(found)[0] == (0, 4) and len(gaps(found)) == 2
    assert list(W.salvage(b"")) == []


def test_one_member_with_several_records_and_payloads_that_look_like_records():
    inner = rec(1, rec(2) + b"\r\n\r\nWARC/1.1\r\n")
    assert ids(W.salvage(gzip.compress(inner + rec(3)))) == [1, 3]
    assert ids(W.salvage(inner + gzip.compress(rec(4)) + rec(5))) == [1, 4, 5]


def test_damage_inside_a_member_has_both_places():
    inner = rec(1) + b"#" * 500 + rec(2) + rec(3).replace(b"Content-Length", b"Content-Longth", 1)
    packed = gzip.compress(inner)
    found = list(W.salvage(b"??" + packed + gzip.compress(rec(9))))
    assert ids(found) == [1, 2, 9]
    inside = [(x["kind"], x["offset"], x["length"], x["inner_offset"], x["inner_length"]) for x in found if "inner_offset" in x]
    n = len(rec(1))
    assert inside == [("record", 2, len(packed), 0, n), ("gap", 2, len(packed), n, 500), ("record", 2, len(packed), n + 500, n), ("gap", 2, len(packed), 2 * n + 500, len(inner) - 2 * n - 500)]


def other(kind, block, content="text/plain", **fields):
    extra = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: {content}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_records_of_other_archives():
    body = b"plain\r\n\r\ntext"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    good = [other("warcinfo", b"software: x"), other("conversion", body, WARC_Payload_Digest=f"sha1:{sha1}"), other("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, "application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{sha1}")]
    found = list(W.salvage(b"".join(good)))
    assert [(x["record_type"], x["payload"]) for x in found] == [("warcinfo", b"software: x"), ("conversion", body), ("response", body)]
    assert found[1]["record_id"] == "<urn:uuid:1>" and found[1]["stated_digest"] == f"sha1:{sha1}" and found[1]["payload_digest"] == hashlib.sha256(body).hexdigest()
    bad = good[1].replace(b"plain\r", b"plane\r")
    assert gaps(W.salvage(good[0] + bad + good[2])) == [(len(good[0]), len(bad))]
    assert gaps(W.salvage(other("resource", body, WARC_Block_Digest="sha256:" + "0" * 64))) and ids(W.salvage(other("resource", body, WARC_Block_Digest="other:1"))) == [None]


def test_time_and_memory_grow_with_the_file_only():
    """Small windows give what large ones give; a bomb of a member is a gap."""
    whole = b"".join((gzip.compress if i % 3 else bytes)(rec(i, b"%d " % i * 300)) for i in range(40))
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 0xFF
    for data in (whole, bytes(broken)):
        for width in (64, 1000, 1 << 20):
            assert list(W.salvage(W.Window(io.BytesIO(data), len(data), width))) == list(W.salvage(data))
    assert gaps(W.salvage(gzip.compress(rec(1, b"z" * 3_000_000)) + rec(2), max_member_mb=1))[0][0] == 0


def test_random_bytes_never_raise():
    r = random.Random(1)
    for _ in range(200):
        data = b"".join(r.choice((rec(1, b"a"), gzip.compress(rec(2, b"b")), r.randbytes(30), W.MAGIC, b"WARC/1.1\r\n", b"WARC/1.0\r\nContent-Length: 99999\r\n\r\n")) for _ in range(6))
        found = list(W.salvage(data))
        assert all(x["length"] > 0 for x in found)


@pytest.fixture
def pages(spark):
    long_ = "é" * 80
    rows = [(i, f"u{i}", h) for i, h in enumerate([None, "", "short", "short", long_, "a" * 100, "a" * 100, "b" * 99, "b" * 99, long_, "a" * 100, "c\r\n\r\nWARC/1.1\r\n" * 20])]
    rows += [(4, "again", long_), (None, "none", long_), (20, None, "x" * 500), (21, "two\r\nlines", "y" * 500)]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(pages, tmp_path):
    manifest = W.write(pages, str(tmp_path), file_mb=0.0005)
    assert manifest.count() > 1
    got = W.read(manifest, keep_payload=True).collect()
    assert len(got) == pages.count() and all(r["kind"] == "record" for r in got)
    by = {r["page_id"]: r for r in got if r["page_id"] not in (4, None)}
    for r in pages.collect():
        if r["page_id"] in (4, None):
            continue
        body = (r["html"] or "").encode()
        g = by[r["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert g["payload"] is None if g["record_type"] == "revisit" else bytes(g["payload"]) == body
    assert {i: by[i]["refers_to"] for i in by if by[i]["record_type"] == "revisit"} == {6: 5, 9: 4, 10: 5}
    assert [r["record_type"] for r in got if r["page_id"] in (4, None)] == ["response"] * 3
    assert W.read(W.write(pages.where("false"), str(tmp_path / "e"))).count() == 0


def test_many_revisits_take_the_shuffle(pages, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    got = W.read(W.write(pages, str(tmp_path))).where("record_type = 'revisit'").collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in got) == [(6, 5), (9, 4), (10, 5)]


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert sorted(map(tuple, W.op4_warc(spark, d).collect()), key=repr) == sorted(con.sql(W.OP4_SQL).fetchall(), key=repr)


def test_a_page_id_with_several_payloads_loses_none(spark):
    a, b = "<p>" + "a" * 200, "<p>" + "b" * 200
    for rows in ([(1, a), (2, a), (2, b)], [(1, a), (2, b), (2, a)], [(2, a), (1, b), (2, b), (1, a), (3, b), (3, b)]):
        pages = spark.createDataFrame([(i, f"http://h/{i}", x, "z") for i, x in rows], "page_id long, url string, html string, digest string")
        got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.read(W.write(pages)).collect())
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        first = {x: min(i for i, y in rows if y == x) for _, x in rows}
        assert got == sorted((i, digest(x), "revisit" if i > first[x] else "response", first[x] if i > first[x] else None) for i, x in rows)
        assert {x for _, _, kind, _ in got for x in [kind]} <= {"response", "revisit"} and {d for _, d, kind, _ in got if kind == "response"} == {digest(a), digest(b)}


def test_the_bound_of_members_is_the_readers(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h", "x" * 3_000_000)], "page_id long, url string, html string")
    manifest = W.write(pages, str(tmp_path / "w"))
    assert [r["kind"] for r in W.read(manifest, max_member_mb=1).collect()] == ["gap"]
    assert [(r["kind"], r["payload_bytes"]) for r in W.read(manifest).collect()] == [("record", 3_000_000)]
