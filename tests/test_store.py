"""Snapshots, objects, exports and file scans."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import store


def test_snapshot(spark, tmp_path):
    base = str(tmp_path / "s")
    one = spark.createDataFrame([(1, "a"), (2, None)], "i long, t string")
    store.write_snapshot(spark, base, 1, {"t": one})
    store.write_snapshot(spark, base, 2, {"t": one.union(one), "u": one.limit(0)})
    found = store.read_snapshot(spark, base)
    assert found["t"].count() == 4 and found["u"].count() == 0
    # A state whose manifest was never written doesn't count.
    one.write.parquet(f"{base}/state=3/t")
    assert store.read_snapshot(spark, base)["t"].count() == 4
    one.write.mode("append").parquet(f"{base}/state=2/t")
    with pytest.raises(ValueError, match="doesn't match"):
        store.read_snapshot(spark, base)


def test_objects(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string").select(F.encode("t", "UTF-8").alias("body"))
    objects = store.write_objects(rows, "body", str(tmp_path / "o"))
    assert objects.count() == 2 and store.damaged_objects(objects).count() == 0
    broken = objects.withColumn("content", F.encode(F.lit("x"), "UTF-8"))
    assert store.damaged_objects(broken).count() == 2


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'quote " é', None), (2, None, [1, 2])], "b long, a string, c array<int>")
    store.export_json({"t": df}, str(tmp_path / "j"))
    back = store.import_json(spark, str(tmp_path / "j"), {"t": "b long, a string, c array<int>"})["t"]
    assert sorted(map(str, back.select("b", "a", "c").collect())) == sorted(map(str, df.collect()))
    assert spark.read.text(str(tmp_path / "j/t")).filter("value LIKE '{\"a\":%'").count() == 2


def test_files(spark, tmp_path):
    for name, body in {"a.md": b"# x", "b.txt": "é".encode(), "c.txt": b"%PDF-1.7 x", "d.txt": b"a\x00b", "e.txt": b"\xff\xfe", "f.txt": b"x" * 200}.items():
        (tmp_path / name).write_bytes(body)
    rows = store.files(spark, str(tmp_path), limit_bytes=100).collect()
    got = {r.path.rsplit("/", 1)[1]: (r.media_type, r.text) for r in rows}
    assert got == {
        "a.md": ("text/markdown", "# x"), "b.txt": ("text/plain", "é"), "c.txt": ("application/pdf", None),
        "d.txt": ("binary", None), "e.txt": ("not_utf8", None), "f.txt": ("too_large", None),
    }
