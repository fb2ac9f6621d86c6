import hashlib

import pytest

from folioweave.llm import warc


def rows():
    big, other = "x" * 1000, "é" * 700
    return [(1, "http://a/", big, "k"), (5, "http://b/ c\r\nX: y", big, "k"), (3, None, big, "k"), (7, "u", "y" * 999, "k"), (8, "u", "y" * 999, "k"), (9, "u", None, "k"), (10, "u", "", "k"), (12, "u", other, "k"), (11, "u", other, "k"), (20, "u", "\r\n\r\n<p>", "k"), (30, "u", "z" * 3_000_000, "k")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.warc_round_trip(df).collect()}
    assert len(got) == len(rows())
    for i, _, html, _ in rows():
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 5, 3: 5, 11: 12}
    listed = warc.archives(df, f"file://{tmp_path}/made", archive_bytes=2000).collect()
    assert sum(r.records for r in listed) == len(rows()) and len(listed) > 1
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/made/*.warc.zst")
    assert {(r.path.rpartition("/")[2], r.length) for r in files.select("path", "length").collect()} == {(r.archive.rpartition("/")[2], r.bytes) for r in listed}
    for found in (warc.read_archives(files), warc.read_files(spark.createDataFrame(listed))):
        full = {r.page_id: r.payload for r in found.collect()}
        assert len(full) == len(rows()) and full[20] == b"\r\n\r\n<p>" and full[5] == b"x" * 1000 and full[1] is None


def test_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_round_trip(df).count() == 0
    assert list(warc.read_archive(b"")) == []


def test_repeated_rows_and_null_id(spark):
    df = spark.createDataFrame([(4, "u", "q" * 1200), (4, "u", "q" * 1200), (2, "u", "q" * 1200), (None, "u", "small")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type) for r in warc.warc_round_trip(df).collect())
    assert got == [("2", "revisit"), ("4", "response"), ("4", "response"), ("None", "response")]


def archive(n=40):
    made = []
    for i in range(n):
        body = f"<p>page {i}</p>".encode() * 20
        made.append(warc.record_bytes(i, f"http://x/{i}", "response", None, body, hashlib.sha1(body).hexdigest()))
    return made, warc.write_archive(made)


def test_frames_one_by_one_and_damage():
    records, data = archive()
    assert [r["page_id"] for r in warc.read_archive(data)] == list(range(40))
    start = 8 + int.from_bytes(data[4:8], "little")
    assert warc.frame_end(memoryview(data), start) < len(data)
    for cut in (len(data) - 1, start + 5, start + 30, 6):
        with pytest.raises((warc.CorruptArchive, Exception)):
            list(warc.read_archive(data[:cut]))
            raise warc.CorruptArchive if cut < 8 else AssertionError
    flipped = bytearray(data)
    flipped[-20] ^= 0xFF
    with pytest.raises(warc.CorruptArchive):
        list(warc.read_archive(bytes(flipped)))


@pytest.mark.parametrize("old,new", [(b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type", b"WARC-Tipe"), (b"page 3", b"page 4"), (b"\r\n\r\n", b"\r\n")])
def test_bad_records(old, new):
    records, _ = archive(5)
    with pytest.raises(warc.CorruptArchive):
        warc.parse_record(records[3].replace(old, new, 1))
