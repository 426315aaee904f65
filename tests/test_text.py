"""The text kernel against plain Python."""

import base64
import hashlib
import math
import re
import uuid
from collections import Counter

from pyspark.sql import functions as F

from ledgerlight.functions import text as T

TEXTS = ["", "Straße ÖL_2 x-y", "a😀b\nc", "  many   spaces\n\nhere ", "東京 Café", "No! Letters? 12.", "ſ ﬁ"]


def test_kernel(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    rows = df.select("t", T.tokens(t).alias("w"), T.collapse(t).alias("c"), T.normalize(t).alias("n"), T.digest(t).alias("d"), T.uuid5(t).alias("u"), T.line_at(t, F.length(t)).alias("l"), T.entropy(F.concat(t, F.lit("x"))).alias("e")).collect()
    for r in rows:
        assert r.w == re.findall(r"\w+", r.t.lower().replace("ß", "ss"))
        assert r.c == " ".join(r.t.split())
        assert r.n == re.sub("[^a-z0-9]+", " ", r.t.lower()).strip()
        assert r.d == hashlib.sha256(r.t.encode()).hexdigest()
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.t))
        assert r.l == r.t.count("\n") + 1
        s = r.t + "x"
        assert math.isclose(r.e, -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()), abs_tol=1e-9)


def test_slugs(spark):
    rows = spark.createDataFrame([("A B",), ("A-B",), ("東京 Café",), ("!!",)], "t string").select(T.slugify(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == ["a-b", "a-b", "東京-café", "entity"]


def test_object_paths_of_long_urls(spark, tmp_path):
    """Bytes as one line of base64, where a line of it is full and beyond, against the query's SQL and Python."""
    import duckdb

    from ledgerlight import catalog

    urls = ["", *("u" * n for n in (56, 57, 58, 114, 115, 3000)), "http://東京.example.org/" + "é" * 40, "a\r\nb" * 30, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = catalog.QUERIES["object_paths"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES['object_paths']})").fetchall())
    assert [(r[0], r[1]) for r in got] == [(i, base64.b64encode(u.encode()).decode()) for i, u in enumerate(urls) if u is not None]
