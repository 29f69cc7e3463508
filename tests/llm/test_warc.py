from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from weftable.llm import warc as W


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, h in rows:
        d = sha(h)
        if i is not None and (d not in first or i < first[d]):
            first[d] = i
    out = []
    for i, h in rows:
        d, n = sha(h), len((h or "").encode())
        again = n >= least and d in first and i != first[d]
        out.append((i, n, d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pages(spark, rows_):
    return spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows_], "page_id long, url string, html string")


def test_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert rows(W.report(df)) == brute([(r["page_id"], r["html"]) for r in df.collect()])


ODD = [(5, "same é"), (3, "same é"), (9, "same é"), (1, None), (2, ""), (4, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "x" * 300_000), (7, "x" * 300_000), (8, "\r\n"), (8, "\r\n"), (None, "alone"), (None, "same é"), (10, "\x00\x01")]


def test_odd_rows(spark):
    for least in (0, 5):
        assert rows(W.report(pages(spark, ODD), min_payload=least)) == brute(ODD, least)
    assert W.report(pages(spark, [])).count() == 0
    extra = pages(spark, ODD).withColumns({"digest": F.lit(1), "first_id": F.lit(2), "value": F.lit("v")})
    assert rows(W.report(extra)) == brute(ODD)


def test_captures(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    W.write(pages(spark, ODD[:6]).withColumn("url", F.when(F.col("page_id") > 3, F.lit("http://h/a b"))), path, file_bytes=600)
    found = W.read(spark, path)
    assert found.groupBy("type").count().orderBy("type").collect() == found.sparkSession.createDataFrame([("metadata", 6), ("request", 6), ("response", 3), ("revisit", 3)], "type string, count long").collect()
    got = W.assemble(found).collect()
    assert len(got) == 6 and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in got)
    bodies = {r["metadata"][0]["fields"]["pageid"]: bytes(r["capture"]["payload"]).decode() for r in got if r["capture"]["type"] == "response"}
    assert bodies == {"3": "same é", "1": "", "4": ODD[5][1]}
    assert all(r["capture"]["payload_digest"] == r["capture"]["declared_digest"] for r in got if r["capture"]["type"] == "response")
    ids = {r["metadata"][0]["fields"]["pageid"]: r["capture"] for r in got}
    assert {k: c["refers_to"] for k, c in ids.items() if c["type"] == "revisit"} == {"5": ids["3"]["record_id"], "9": ids["3"]["record_id"], "2": ids["1"]["record_id"]}
    assert {c["target_uri"] for c in ids.values()} == {"urn:none", "http://h/a%20b"}


def members(data):
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return out


def test_every_record_is_a_member_and_revisits_say_what_they_repeat(spark, tmp_path):
    W.write(pages(spark, ODD[:6]), f"file://{tmp_path}/out")
    found = [m for f in (tmp_path / "out").glob("*.warc.gz") for m in members(f.read_bytes())]
    assert len(found) == 18 and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in found)
    revisits = [m for m in found if b"WARC-Type: revisit" in m]
    assert len(revisits) == 3 and all(b"WARC-Refers-To: <urn:uuid:" in m and b"WARC-Refers-To-Target-URI: http://h/" in m and b"WARC-Refers-To-Date: " in m for m in revisits)
    # what an attempt that never committed has left behind is not read
    (tmp_path / "out" / "lost.warc.gz").write_bytes(gzip.compress(RECORD))
    assert W.read(spark, f"file://{tmp_path}/out").count() == 18


def test_ranges_read_each_record_once(spark, tmp_path):
    rng = random.Random(1)
    records = [RECORD.replace(b"<a>", b"<%d>" % i).replace(b"Length: 5", b"Length: %d" % (n := rng.randrange(900))).replace(b"hello", rng.randbytes(n)) for i in range(300)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "pairs.warc.gz").write_bytes(b"".join(gzip.compress(a + b) for a, b in zip(records[::2], records[1::2])))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    for size in (100, 1000, 7777, 1 << 20):
        for f in tmp_path.iterdir():
            reader = W._Reader(f"file://{f}", False, size)
            got = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("record_id").to_pylist()]
            assert sorted(got) == sorted(f"<{i}>" for i in range(300)), (f.name, size)


def test_hostile_records_are_error_rows(spark, tmp_path):
    for i, (old, new) in enumerate([(b"Length: 5", b"Length: " + b"9" * 25), (b"Length: 5", b"Length: " + b"9" * 15), (b"Content-Length", b"X" * (3 << 20))]):
        (tmp_path / f"{i}.warc").write_bytes(RECORD + RECORD.replace(old, new))
    (tmp_path / "digest.warc").write_bytes(RECORD.replace(b"WARC-Type", b"WARC-Payload-Digest: sha1:" + b"z" * 40 + b"\r\nWARC-Type"))
    got = W.read(spark, f"file://{tmp_path}").collect()
    assert [r["type"] for r in got].count("error") == 3 and [r["type"] for r in got].count("response") == 4
    assert all(r["declared_digest"] is None for r in got)


def test_a_capture_of_very_many_records_is_dealt_out(spark):
    df = spark.range(95).select(F.concat(F.lit("<r"), "id", F.lit(">")).alias("record_id"), F.lit("request").alias("type"), F.lit("<c>").alias("concurrent_to"))
    df = df.union(spark.createDataFrame([("<c>", "response", None)], "record_id string, type string, concurrent_to string"))
    for name in ("refers_to", "target_uri", "profile", "payload_digest", "declared_digest"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.withColumns({"payload_bytes": F.lit(0), "fields": F.lit(None).cast("map<string,string>"), "payload": F.lit(None).cast("binary")})
    got = W.assemble(df, part=10).collect()
    assert len(got) > 5 and sum(len(r["requests"]) for r in got) == 95 and max(len(r["requests"]) for r in got) < 40
    assert [r["part"] for r in got if r["capture"]] == [0]


RECORD = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    (tmp_path / "plain.warc").write_bytes(RECORD * 3)
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(RECORD) + gzip.compress(RECORD))
    (tmp_path / "cut.warc").write_bytes(RECORD + RECORD[:-6])
    (tmp_path / "junk.warc").write_bytes(b"nothing")
    (tmp_path / "length.warc").write_bytes(RECORD.replace(b"Length: 5", b"Length: x"))
    (tmp_path / "broken.warc.gz").write_bytes(gzip.compress(RECORD)[:-30] + b"\x00" * 30)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = W.read(spark, f"file://{tmp_path}")
    assert got.filter("type = 'response'").count() >= 6
    reasons = [r["fields"]["reason"] for r in got.filter("type = 'error'").collect()]
    assert len(reasons) == 4 and any("cut short" in x for x in reasons)


def test_concurrent_records_without_a_capture(spark):
    df = spark.createDataFrame([("<r>", "request", "<gone>"), ("<m>", "metadata", None), ("<c>", "response", None), ("<q>", "request", "<c>")], "record_id string, type string, concurrent_to string")
    for name in ("refers_to", "target_uri", "profile", "payload_digest", "declared_digest"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.withColumns({"payload_bytes": F.lit(0), "fields": F.lit(None).cast("map<string,string>"), "payload": F.lit(None).cast("binary")})
    got = {r["capture_id"]: r for r in W.assemble(df).collect()}
    assert set(got) == {"<gone>", "<m>", "<c>"} and got["<gone>"]["capture"] is None and len(got["<c>"]["requests"]) == 1
