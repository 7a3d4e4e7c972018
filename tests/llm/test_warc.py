"""WARC round trips, the normaliser on odd streams, revisit choice."""

import gzip
import io
import json

from tidemark.llm import warc

PAGES = "page_id long, url string, html string"


def test_records_survive_any_chunking():
    records = [warc.record(i, f"http://x/{i}\r\n", b"\r\n\r\nWARC/1.1 " * i, None, False, "d") for i in range(30)]
    stream = b"".join(records)
    for step in (1, 7, 1000, len(stream)):
        pieces = (stream[i : i + step] for i in range(0, len(stream), step))
        assert list(warc.split_records(pieces)) == records
    members = b"".join(gzip.compress(r) for r in records)
    for packed in (gzip.compress(stream), members):
        assert b"".join(warc.inflate(io.BytesIO(packed))) == stream


def test_round_trip(spark):
    rows = [(1, "u", "same"), (5, "v", "same"), (3, None, "same"), (2, "w", None), (4, "w", ""), (7, "x", "é" * 300_000),
            (None, "n", "alone"), (8, "r", "twice"), (8, "r", "twice"), (None, "s", "same")]
    pages = spark.createDataFrame(rows, PAGES)
    folder = warc.scratch_path(spark, "warc-test")
    whole = warc.write_monolithic(pages.selectExpr("*", "1 as digest", "2 as latest"), f"{folder}/a", file_bytes=100)
    members = warc.normalise(whole, f"{folder}/b")
    back = warc.read(members).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or 0) for r in back)
    assert got == sorted([
        (1, 4, "revisit", 5), (5, 4, "response", 0), (3, 4, "revisit", 5), (2, 0, "revisit", 4), (4, 0, "response", 0),
        (7, 600_000, "response", 0), (-1, 5, "response", 0), (8, 5, "response", 0), (8, 5, "response", 0),
        (-1, 4, "revisit", 5)])
    assert {r.payload.decode() for r in back if r.payload is not None} == {"same", "", "é" * 300_000, "alone", "twice"}
    for r in members.collect():
        store, place = warc.filesystem(r.path)
        data = store.open_input_stream(place, compression=None).read()
        index = [json.loads(x) for x in store.open_input_stream(f"{place}.idx", compression=None).read().splitlines()]
        assert len(index) == r.records and index[-1]["offset"] + index[-1]["length"] == len(data)
        assert all(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1") for e in index)


def test_threshold_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    kinds = {r.page_id: r.record_type for r in warc.archive_round_trip(pages, min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
