import base64
import gzip
import hashlib
import io
import zlib

import pytest
from larkspan.llm import warc

PAGES = "page_id long, url string, html string, refers_to string, file int"


def test_archive_round_trip(spark, tmp_path):
    html = ["<p>é\r\n\r\nWARC/1.1\r\n</p>", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "", None, "x" * 3_000_000, "solo", "solo"]
    ids = [5, 9, 1, 2, 3, 4, None]
    df = spark.createDataFrame([(i, f"http://e.x/{i}\r\nX: y", h, "c", 1) for i, h in zip(ids, html)], PAGES).repartition(3)
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.archive_pages(df, uri=f"file://{tmp_path}/w", payloads=True).collect()}
    assert len(got) == len(ids)
    for i, h in zip(ids, html):
        raw = (h or "").encode()
        r = got[i, len(raw)]
        same = [j for j, g in zip(ids, html) if (g or "") == (h or "") and j is not None]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["record_type"] == ("response" if i == max(same) else "revisit")
        assert r["refers_to"] == (None if i == max(same) else max(same))
        assert bytes(r["payload"]) == (raw if i == max(same) else b"")
    names = sorted(p.name for p in (tmp_path / "w").iterdir())
    assert all(".members.warc.gz" in n or n.endswith(".warc.gz") for n in names)
    for p in (tmp_path / "w").glob("*.members.warc.gz"):
        data = p.read_bytes()
        for at, n, page, known in warc.ENTRY.iter_unpack((tmp_path / "w" / (p.name + ".idx")).read_bytes()):
            fields, _ = warc.parse(zlib.decompress(data[at : at + n], 31))
            assert fields.get("x-page-id") == (str(page) if known else None)
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == len(list(warc.ENTRY.iter_unpack((tmp_path / "w" / (p.name + ".idx")).read_bytes())))


def test_least_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "abc", None, None), (2, "u", "abc", None, None), (3, "u", "abcdef", None, None), (4, "u", "abcdef", None, None)], PAGES)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(df, least=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_splitter_and_inflate_in_small_chunks(monkeypatch):
    records = [warc.record(i, "u", b"\r\n\r\n" * i, None if i % 2 else 7) for i in range(20)]
    whole = gzip.compress(b"".join(records[:11])) + gzip.compress(b"".join(records[11:]))
    monkeypatch.setattr(warc, "CHUNK", 13)
    split, out = warc.Splitter(), []
    for chunk in warc.inflate(io.BytesIO(whole)):
        out += list(split.feed(chunk))
    split.close()
    assert out == records
    split = warc.Splitter()
    list(split.feed(records[3][:-1]))
    with pytest.raises(ValueError):
        split.close()


def test_repeat_of_a_normalised_file_is_idle(tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(warc.record(1, "u", b"x", None)))
    first = warc.normalise_file(f"file://{tmp_path}", str(path))
    assert not path.exists() and warc.normalise_file(f"file://{tmp_path}", str(path)) == first


def test_truncated_archives_are_errors():
    """Cut anywhere, also at the end of a record, before the trailer of the last member."""
    whole = gzip.compress(warc.record(1, "u", b"abc", None)) + gzip.compress(warc.record(2, "u", b"x" * 5000, None))
    assert b"".join(warc.inflate(io.BytesIO(whole))).count(b"WARC/1.1") == 2 and list(warc.inflate(io.BytesIO(b""))) == []
    for cut in (1, 4, 8, 9, 20):
        with pytest.raises(ValueError, match="inside a gzip member"):
            list(warc.inflate(io.BytesIO(whole[:-cut])))


def test_each_file_has_a_task(spark, tmp_path):
    df = spark.createDataFrame([(k, f"u{k}", f"page {k}", None, None) for k in range(60)], PAGES).repartition(6, "page_id")
    files = warc.write_archives(df, f"file://{tmp_path}/w")
    n = files.count()
    assert sorted(len(p) for p in warc.one_by_one(files).rdd.glom().collect() if p) == [1] * n
