import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import work_folder
from tidemark.llm.warc import WarcReader, base32_sha1, read_archives, register, with_revisits, write_archives

PAGES = "page_id long, url string, html string, record_id string, same string"


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/1", "<p>é</p>", "x", "y"), (2, "http://a/2", "<p>é</p>", None, None), (3, None, None, "x", "y"), (4, "http://b/4\r\nWARC-Type: fake", "", "x", "y"),
         (5, "http://b/5", "WARC/1.1\r\n\r\n" + "z" * 300_000, "x", "y"), (None, "http://c", "<p>é</p>", "x", "y"), (6, "http://a/6", "tail", "x", "y"), (6, "http://a/6", "tail", "x", "y")],
        PAGES,
    )
    folder = work_folder(spark, "warc-test")
    write_archives(with_revisits(pages).repartition(3), folder)
    return pages, folder


def test_round_trip(spark, archive):
    pages, folder = archive
    rows = read_archives(spark, folder).where("record_type <> 'warcinfo'").collect()
    assert len(rows) == pages.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["record_id"], []).append(r)
    for p in pages.collect():
        payload = (p["html"] or "").encode()
        for r in by_id[f"urn:page:{'null' if p['page_id'] is None else p['page_id']}"]:
            assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base32_sha1(payload)
            assert r["record_type"] == "revisit" or (bytes(r["payload"]) == payload and r["digest_ok"])
    kinds = {k: [(r["record_type"], r["refers_to"]) for r in v] for k, v in by_id.items()}
    assert kinds["urn:page:1"] == [("response", None)] and kinds["urn:page:2"] == [("revisit", "urn:page:1")] and kinds["urn:page:null"] == [("revisit", "urn:page:1")]
    assert kinds["urn:page:3"] == [("response", None)] and kinds["urn:page:4"] == [("revisit", "urn:page:3")] and kinds["urn:page:6"] == [("response", None)] * 2


def test_any_split_reads_each_record_once(spark, archive):
    _, folder = archive
    register(spark)
    for size in (64, 1000, 5_000_000):
        rows = spark.read.format("warc").option("split_bytes", size).load(folder)
        assert rows.count() == 8 + rows.where("record_type = 'warcinfo'").count()
        assert rows.select("file", "offset").distinct().count() == rows.count()


def test_predicates_reach_the_reader_and_payloads_are_skipped(spark, archive, capfd):
    _, folder = archive
    some = read_archives(spark, folder, payload=False).where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://a/"))
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:page:1", "urn:page:6", "urn:page:6"]
    assert some.where("payload IS NOT NULL").isEmpty()
    some.explain()
    plan = capfd.readouterr().out
    assert "Filter" not in plan.split("BatchScan")[0] or "record_type" not in plan.split("BatchScan")[0]
    reader = WarcReader(folder, True, 1 << 20)
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "http://a/"), EqualTo(("payload_bytes",), 3)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and len(reader.wanted) == 2


def test_reads_records_of_others_and_uncompressed_files(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nX: a\r\n b\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(record % i for i in range(3)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record % i) for i in range(3, 6)))
    rows = read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["record_id"] for r in rows) == [f"urn:x:{i}" for i in range(6)]
    assert all(bytes(r["payload"]) == b"hello" and r["content_type"] == "text/plain" for r in rows)


def test_empty(spark):
    folder = work_folder(spark, "warc-none")
    write_archives(with_revisits(spark.createDataFrame([], PAGES)), folder)
    assert read_archives(spark, folder).where("record_type <> 'warcinfo'").collect() == []
