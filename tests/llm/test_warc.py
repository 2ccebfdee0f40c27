import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from driftwell.llm import warc


def rows():
    big, hot = "é" * 700, "<p>x</p>" * 200
    out = [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, None, None), (4, "http://a/\r\nX: y", ""), (5, "u", big), (6, "u", big), (7, "u", "a\r\n\r\nb" * 300), (None, "n", hot)]
    return out + [(k, f"h{k}", hot) for k in range(10, 60)] + [(59, "again", hot)]


def expect(table):
    top = {}
    for i, _, h in table:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for i, _, h in table:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and i != top[h]
        yield (i if i is not None else -1, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None)


def test_round_trip_and_index(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id long, url string, html string, file string").repartition(3)
    index = warc.write(df, f"file://{tmp_path}/archives")
    key = lambda x: (x[0], x[3], x[4] or 0)
    got = warc.read(index).collect()
    assert sorted(((r.page_id if r.page_id is not None else -1, *r[1:]) for r in got), key=key) == sorted(expect(rows()), key=key)
    # the payloads of selected records
    some = warc.read(index.where(F.col("page_id").isin(5, 6, 7)), payloads=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {5: "", 6: "é" * 700, 7: "a\r\n\r\nb" * 300}
    # archives are whole gzip files of records, and the index points at each
    spots = {}
    for r in index.collect():
        spots.setdefault(r.file, []).append((r.offset, r.length))
    for f in (tmp_path / "archives").glob("*.gz"):
        if f.name in spots:
            assert gzip.open(f).read().count(b"WARC/1.1\r\n") == len(spots[f.name])
            assert sum(n for _, n in spots[f.name]) == f.stat().st_size


def test_empty_table(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    payload = b"x" * 50
    data = warc.record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None, False)
    assert warc.parse(data, hashlib.sha1(payload).hexdigest())["payload"] == payload
    for bad, digest in ((data.replace(b"xxx", b"xyx"), None), (data, "0" * 40), (data[:-20], None)):
        with pytest.raises(ValueError):
            warc.parse(bad, digest)
    index = warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    with pytest.raises(Exception, match="another digest"):
        warc.read(index.withColumn("digest", F.lit("0" * 40))).collect()


def test_archives_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE", 1 << 10)
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(cast(id as string), 512), 20) AS html")
    got = warc.read(warc.write(pages.repartition(1)))
    assert got.rdd.getNumPartitions() == 8 and got.count() == 200
