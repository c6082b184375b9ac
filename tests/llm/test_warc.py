import hashlib

import pytest
import zstandard as zstd

from tidemark.llm import warc
from tidemark.llm._common import shared_folder


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, salt int").repartition(3)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_round_trip(spark, monkeypatch, hot):
    """Also with every payload that repeats found by the broadcast."""
    monkeypatch.setattr(warc, "HOT", hot)
    long, other = "x" * 1500 + "é", "y" * 999
    rows = [(1, "http://a/ b\r\n", long), (5, None, long), (3, "u", long), (2, "u", other), (4, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nx" * 400), (None, "u", long)]
    table = pages(spark, [(*r, "p", 1) for r in rows])
    folder = shared_folder(spark, "warc")
    got = {r.page_id: r for r in warc.round_trip(table, folder).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha1(raw).hexdigest()
        revisit = html == long and i != 5
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 5) if revisit else ("response", None))
    whole = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert bytes(whole[5].payload) == long.encode() and whole[3].payload is None


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, []), shared_folder(spark, "warc")).collect() == []


def test_broken_archives():
    dictionary = b"HTTP/1.1 200 OK Content-Type: text/html" * 4
    record = warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    coder = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT))
    whole = warc.dictionary_frame(dictionary) + coder.compress(record) + coder.compress(record)
    assert [r[0] for r in warc.read_archive(whole)] == [1, 1]
    packed = warc.dictionary_frame(zstd.ZstdCompressor().compress(dictionary)) + coder.compress(record)
    assert [r[6] for r in warc.read_archive(packed)] == [b"hello"]
    for broken in (whole[:-3], whole[:20], whole[:-20] + b"\0" * 20):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))
    for bad in (record[:-1], record.replace(b"hello", b"hullo"), record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b"")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
