import hashlib
import io

import pytest

from morpholake.llm import warc


@pytest.fixture()
def pages(spark):
    long_ = "<p>" + "same payload " * 20
    rows = [(5, "http://a/5", long_), (3, "http://a/3", long_), (9, None, long_), (1, "http://a/1", "short"), (2, "http://a/2", "short"), (7, "http://a/7\r\nX-Evil: 1", None), (8, "http://é/8", "é" * 60), (10, "http://a/10", "x" * 300_000), (None, "http://a/n", long_), (3, "http://a/3", long_)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("digests", [300_000, -1])
def test_round_trip(spark, pages, monkeypatch, digests):
    """Also by the way without a broadcast."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", digests)
    rows = warc.round_trip(pages).collect()
    assert len(rows) == pages.count()
    by = {r.page_id: r for r in rows}
    for p in pages.collect():
        data = (p.html or "").encode()
        assert by[p.page_id].payload_bytes == len(data) and by[p.page_id].payload_digest == hashlib.sha256(data).hexdigest()
    assert {k: (r.record_type, r.refers_to) for k, r in by.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 7: ("response", None), 8: ("response", None), 10: ("response", None), None: ("revisit", 3)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_filters_reach_the_reader(spark, pages, tmp_path):
    warc.write_pages(pages, path := f"file://{tmp_path}/w")
    read = spark.read.format("warc").load(path)
    assert read.filter("record_type = 'revisit'").count() == 3
    assert [r.target_uri for r in read.filter("target_uri in ('http://a/5', 'http://a/1') and record_type = 'response'").collect()] == ["http://a/1"]
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload is not null").count() == 0
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader({"path": path})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("date",), "2000")]))
    assert len(rest) == 1 and reader.wanted == {"warc-type": frozenset(["revisit"])}


@pytest.mark.parametrize("packed", [True, False])
def test_unwanted_blocks_are_passed_over(packed):
    import zlib

    def one(kind, n):
        data = warc.record_bytes([("WARC-Type", kind)], b"z" * n)
        if not packed:
            return data
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    raw = io.BytesIO(one("warcinfo", 5) + one("response", 200_000) + one("revisit", 0) + one("response", 3))
    found = list(warc.records(raw, packed, {"warc-type": frozenset(["response"])}, True))
    assert [len(b) for _, b in found] == [200_000, 3]


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"no record\r\n\r\n"), False, {}, True))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"), False, {}, True))


def test_query(spark, sf):
    from morpholake.llm.queries import op8_warc

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op8_warc(spark, sf).collect()
    assert {r.page_id: r.payload_digest for r in rows} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in pages.items()}
