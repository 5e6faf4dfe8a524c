import base64
import gzip
import hashlib
import io

import pytest
from packlane.llm import warc


def by_hand(rows):
    keep = {}
    for p, _, h in rows:
        k = h or ""
        keep[k] = max(keep.get(k, -(1 << 63)), -(1 << 63) if p is None else p)
    out = []
    for p, _, h in rows:
        data, most = (h or "").encode(), keep[h or ""]
        response = p == most or most == -(1 << 63)
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else most))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/", "same"), (2, None, "same"), (9, "x\r\nEvil: 1", "same"), (3, "u", None), (4, "u", ""), (-5, "é", "ünï\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (None, "v", "only"), (7, "u", "long " * 300_000), (9, "x", "same"), (11, "u", "\r\n" * 1000)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(warc.common.join_small, "__defaults__", ("left", limit, 4))
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    uri, files = warc.write(df)
    chunks = warc.read(uri, files, chunk=100_000).collect()
    last = [r for r in chunks if r.last]
    got = [(r.page_id, r.bytes_so_far if r.record_type == "response" else r.declared_bytes, r.declared_digest, r.record_type, r.refers_to) for r in last]
    assert sorted(got, key=repr) == by_hand(ROWS)
    assert all(r.digest_so_far == r.declared_digest for r in last if r.record_type == "response")
    long = sorted((r for r in chunks if r.page_id == 7), key=lambda r: r.chunk)
    assert len(long) == 15 and b"".join(bytes(r.bytes) for r in long).decode() == "long " * 300_000
    so_far = hashlib.sha1()
    for r in long:
        so_far.update(r.bytes)
        assert r.digest_so_far == base64.b32encode(so_far.digest()).decode()


def test_empty_table(spark):
    uri, files = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(uri, files).count() == 0


def test_a_long_payload_is_written_without_a_copy():
    import tracemalloc

    payload = bytes(40 << 20)
    tracemalloc.start()
    size = sum(len(x) for x in warc.pieces(1, "u", payload, None, False))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > len(payload) and most < 1 << 20


def test_damage_is_seen():
    whole = gzip.compress(warc.record(1, "u", b"payload" * 100, None, False))
    assert list(warc.read_records(io.BytesIO(whole)))
    for cut in (10, len(whole) // 2, len(whole) - 1):
        with pytest.raises((warc.DamagedArchive, EOFError)):
            list(warc.read_records(io.BytesIO(whole[:cut])))
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(gzip.compress(warc.record(1, "u", b"payload" * 100, None, False).replace(b"payloadpay", b"payloadPay", 1)))))
    short = warc.record(1, "u", b"payload", None, False).replace(b"Content-Length: 7\r", b"Content-Length: 7\r")
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(gzip.compress(short[:-6]))))
    assert [warc.page_of(warc.record_id(x)) for x in (None, 0, -1, 5, 1 << 62)] == [None, 0, -1, 5, 1 << 62]


def test_buffer_stays_small():
    data = gzip.compress(warc.record(1, "u", b"\0" * (20 << 20), None, False), 1)
    stream = warc.Stream(io.BytesIO(data))
    most = 0
    stream.until(b"\r\n\r\n", 1 << 20)
    for _ in range(200):
        stream.take(1000)
        most = max(most, len(stream.plain))
    assert most <= 4 * warc.READ


@pytest.mark.parametrize("read", [1, 2, 3, 7, 300])
def test_members_after_long_ones(monkeypatch, read):
    monkeypatch.setattr(warc, "READ", read)
    payloads = [bytes(range(256)) * n + b"x" * n * 50 for n in (30, 1, 0, 40, 40, 2)]
    data = b"".join(gzip.compress(warc.record(i, "u", p, None, False)) for i, p in enumerate(payloads))
    got = {}
    for r in warc.read_records(io.BytesIO(data), 1000):
        got[r["page_id"]] = got.get(r["page_id"], b"") + r["bytes"]
    assert [got[i] for i in range(len(payloads))] == payloads
