import base64
import hashlib
import time

import pytest

from packetloom.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def brute(rows, min_bytes=0):
    first = {}
    for k, _, h in rows:
        p = (h or "").encode()
        first[p] = min(first.get(p, (k is not None, k or 0)), (k is not None, k or 0))
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= min_bytes and first[p] != (k is not None, k or 0)
        to = (first[p][1] if first[p][0] else None) if again else None
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", to))
    return sorted(out, key=str)


ROWS = [(3, "http://a/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (2, None, None), (4, "http://c\r\nX: y/", ""), (5, "u", "é" * 30000), (6, "u", "é"), (6, "u", "é"), (7, "v", "é"), (8, "w", "<p>x</p>")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "t") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_matches_brute_force(spark, tmp_path, least):
    warc.write_archive(frame(spark).select("page_id", "url", "html"), str(tmp_path / "a"), least)
    assert sorted(map(tuple, warc.read_archive(spark, str(tmp_path / "a")).collect()), key=str) == brute(ROWS, least)


def test_null_ids_come_first(spark, tmp_path):
    rows = [(1, "a", "same"), (None, "b", "same")]
    warc.write_archive(frame(spark, rows), str(tmp_path / "a"))
    assert sorted(map(tuple, warc.read_archive(spark, str(tmp_path / "a")).collect()), key=str) == brute(rows)


def test_payloads_are_stored_once_and_verified(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(frame(spark), path)
    assert warc.payloads(spark, path).count() == len({(h or "") for *_, h in ROWS})
    wrong = spark.createDataFrame([("0" * 64, b"x")], "sha256 string, payload binary")
    wrong.write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.payloads(spark, path).collect()


def test_what_is_read_comes_from_the_records(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(frame(spark), path)
    rows = [(r.page_id, bytes(r.header), r.sha256) for r in warc.records(spark, path).collect()]
    assert {h is None for _, header, h in rows if b"WARC-Type: revisit" in header} == {True}
    for change in (lambda h: h.replace(b"sha1:", b"sha1:A"), lambda h: h.replace(b"Content-Length: ", b"Content-Length: 1")):
        other = str(tmp_path / f"b{change(b'sha1:').decode()[:6]}x")
        spark.createDataFrame([(k, bytearray(change(h)), s) for k, h, s in rows], warc.RECORD).write.parquet(f"{other}/records")
        warc.payloads(spark, path).write.parquet(f"{other}/payloads")
        with pytest.raises(Exception, match="does not match its header"):
            warc.read_archive(spark, other).collect()


def test_a_missing_payload_fails(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.createDataFrame([(1, bytearray(b"WARC/1.1\r\n\r\n"), "0" * 64)], warc.RECORD).write.parquet(f"{path}/records")
    spark.createDataFrame([], "sha256 string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="no payload"):
        warc.reconstruct(spark, path).collect()


def test_records_are_well_formed(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(frame(spark), path)
    for r in warc.reconstruct(spark, path).collect():
        ((header, body),) = warc.split_records(bytes(r.record))
        assert header.startswith(b"WARC/1.1\r\nWARC-Type: re") and b"\r\nX: y" not in header
        assert body in {(h or "").encode() for *_, h in ROWS} | {b""}


def test_ordinary_files_survive_a_round_trip(spark, tmp_path):
    header = "WARC/1.0\r\nWARC-Type: resource\r\nX-Odd:  spaced \r\ncontent-length: {}\r\n\r\n"
    bodies = [b"", b"\x00\xff\r\n\r\nWARC/1.0", "é".encode(), b"\x00\xff\r\n\r\nWARC/1.0"]
    data = b"".join(header.format(len(b)).encode() + b + b"\r\n\r\n" for b in bodies)
    (tmp_path / "x.warc").write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path / "x.warc")).withColumnRenamed("at", "page_id")
    warc.add_records(rows, str(tmp_path / "a"))
    assert warc.payloads(spark, str(tmp_path / "a")).count() == 3
    # add_records keeps bodies for all records
    got = warc.reconstruct(spark, str(tmp_path / "a")).orderBy("page_id").collect()
    assert b"".join(bytes(r.record) for r in got) == data
    for bad in (data[:-1], b"x" + data, data[:40]):
        with pytest.raises(ValueError):
            list(warc.split_records(bad))


def test_empty(spark, tmp_path):
    warc.write_archive(frame(spark, []), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).collect() == []


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(k).getName() for k in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_no_shuffle_outlives_its_job(spark, tmp_path):
    path, setting = str(tmp_path / "a"), spark.conf.get(warc.CLEANUP)
    pages, old = frame(spark).select("page_id", "url", "html"), shuffle_files(spark)
    for job in (lambda: warc.write_archive(pages, path), lambda: warc.read_archive(spark, path)):
        job()
        until = time.monotonic() + 10
        while (left := shuffle_files(spark) - old) and time.monotonic() < until:
            time.sleep(0.1)
        assert not left
    assert spark.conf.get(warc.CLEANUP) == setting
    assert sorted(map(tuple, warc.read_archive(spark, path).collect()), key=str) == brute(ROWS)
