"""Archives: exact round trip, revisits, and broken archives."""

import base64
import hashlib
import io

import pytest

from pairlens.llm.store import new_path
from pairlens.llm.warc import _opened, dictionary_frame, make_dictionary, parse_record, read_archives, read_frames, record_bytes, write_archives

ROWS = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, " odd\r\nurl ", "é" * 9), (4, "u", None), (5, "%20", ""), (None, "n", "<p>x</p>"), (7, "big", "long " * 500_000), (8, "", "y"), (8, "", "y")]


def trip(spark, rows, **options):
    folder = new_path(spark, "warc-test")
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    return read_archives(write_archives(pages, folder, **options), folder).collect()


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        to = first.get(data) if first.get(data) != page else None
        out.append((page, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to, data if to is None else None))
    return out


@pytest.mark.parametrize("options", [{}, {"archive_mb": 0}, {"min_revisit_bytes": 5}, {"sample_records": 0}, {"sample_records": 1}])
def test_round_trip(spark, options):
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in trip(spark, ROWS, **options)]
    assert sorted(map(str, got)) == sorted(map(str, expected(ROWS, options.get("min_revisit_bytes", 0))))


def test_registered_query(spark, sf_dir):
    from pairlens.llm.queries import op8_warc

    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(tuple(r) for r in op8_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").fillna(-1).collect())
    assert got == sorted((p, n, d, k, -1 if t is None else t) for p, _, n, d, k, t, _ in expected(pages))


def test_no_pages(spark):
    assert trip(spark, []) == []


def archive(records):
    import zstandard

    dictionary = make_dictionary(records)
    encoder = zstandard.ZstdCompressor(dict_data=dictionary)
    return dictionary_frame(dictionary) + b"".join(map(encoder.compress, records))


def test_broken_archives_are_refused(spark):
    record = record_bytes(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert [parse_record(d)["page_id"] for d in read_frames(io.BytesIO(archive([record] * 3)), chunk=7)] == [1, 1, 1]
    whole = archive([record])
    for bad in (whole[:-3], whole[8:], whole[:20]):
        with pytest.raises(ValueError):
            list(read_frames(io.BytesIO(bad)))
    for bad in (record[:-1], record.replace(b"payload", b"Payload"), record.replace(b"WARC-Date", b"Date"), record.replace(b"WARC/1.1", b"WARC/9")):
        with pytest.raises(ValueError):
            parse_record(bad)
    folder = new_path(spark, "warc-bad")
    system, base = _opened(folder if "://" in folder else f"file://{folder}")
    system.create_dir(base)
    with system.open_output_stream(f"{base}/x", compression=None) as out:
        out.write(archive([record]) + whole[-9:])
    rows = read_archives(spark.createDataFrame([("x",)], "archive string"), folder, on_error="report").collect()
    assert [r.page_id for r in rows if r.error is None] == [1] and sum(r.error is not None for r in rows) == 1
