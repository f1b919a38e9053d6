import glob
import gzip
import hashlib
import io
import json
import zlib

import pytest
from courtflow.llm.warc import archive_and_read, mark_revisits, normalise, parse_record, read_records, record_bytes, records, write_archives

KIND = "page_id long, url string, html string"


def test_records_of_any_members_and_chunks():
    wanted = [record_bytes(i, f"http://a/{i}\r\nx", (b"body\r\n\r\n%d" % i) * 500 * (i % 3), "00" * 20, "response", None) for i in range(20)]
    for data in (gzip.compress(b"".join(wanted)), b"".join(map(gzip.compress, wanted)), gzip.compress(b"".join(wanted[:7])) + gzip.compress(b"".join(wanted[7:]))):
        assert list(records(io.BytesIO(data))) == wanted
    with pytest.raises(ValueError):
        list(records(io.BytesIO(gzip.compress(wanted[0][:-9]))))
    assert list(records(io.BytesIO(b""))) == []


def test_round_trip_with_odd_rows(spark, tmp_path):
    big = "é<p>" * 400
    rows = [(1, "http://a", big), (9, "http://b c\n", big), (9, "http://b c\n", big), (5, None, big), (None, "x", big), (2, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"),
            (7, "u", "x" * 3_000_000), (None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    got = archive_and_read(df.withColumns({c: df.page_id for c in ("digest", "head", "archive", "offset")}), str(tmp_path / "w")).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, len((t or "").encode()), sha(t), *(("revisit", 9) if t == big and p != 9 else ("response", None))) for p, _, t in rows]
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    assert all(r.record_type == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    lines = 0
    for index in glob.glob(str(tmp_path / "w" / "*.idx")):
        data = open(index[:-4], "rb").read()
        for line in map(json.loads, open(index)):
            head, _ = parse_record(zlib.decompress(data[line["offset"] : line["offset"] + line["length"]], 31))
            assert head["warc-record-id"] == line["record_id"]
            lines += 1
    assert lines == len(rows)
    assert archive_and_read(spark.createDataFrame([], KIND)).count() == 0


def test_archives_are_normalised_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("courtflow.llm.warc.ARCHIVE_BYTES", 2000)
    rows = spark.createDataFrame([(i, f"http://a/{i}", f"text {i} " * 50) for i in range(64)], KIND).repartition(16, "page_id")
    folder = str(tmp_path / "many")
    archives = write_archives(mark_revisits(rows), folder)
    index = normalise(archives, folder)
    tasks = {name.rsplit("-", 1)[1] for (name,) in index.select("archive").distinct().collect()}
    assert archives.count() >= 6 and len(tasks) >= 4
    assert read_records(index, folder).where("intact").count() == 64


def test_a_damaged_payload_shows(spark, tmp_path):
    folder = tmp_path / "bad"
    folder.mkdir()
    good = record_bytes(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), "response", None)
    for name, data in (("stream-1.warc.gz", good), ("stream-2.warc.gz", good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n").replace(b"page:1", b"page:2"))):
        (folder / name).write_bytes(gzip.compress(data))
    listed = spark.createDataFrame([("stream-1.warc.gz", 1), ("stream-2.warc.gz", 1)], "archive string, records long")
    got = {r.page_id: r for r in read_records(normalise(listed, str(folder)), str(folder)).collect()}
    assert got[1].intact and not got[2].intact and got[2].payload_digest == hashlib.sha1(b"pAyload").hexdigest()
