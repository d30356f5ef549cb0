import duckdb

from sparkvane.llm import warc as m

SCHEMA = "record_id long, url string, at long, kind string, headers map<string,string>, payload string"


def test_canonical(spark):
    same = ["http://www.A.example/x/1.html", "https://a.example/x/1/", "https://a.example:443/x/1#top", "HTTPS://u:p@a.example/x/1?utm_source=f&ref=2"]
    other = ["https://a.example/x/1?b=2&a=1", "https://a.example/X/1", "https://b.example/x/1", "", None]
    df = spark.createDataFrame([(u,) for u in same + other], "url string")
    got = [r[0] for r in df.select(m.canonical_url(df.url)).collect()]
    assert set(got[:4]) == {"a.example/x/1"}
    assert got[4:] == ["a.example/x/1?a=1&b=2", "a.example/X/1", "b.example/x/1", "", None]


def test_resolution(spark):
    u = "http://a.example/p"
    rows = [
        (1, u, 10, "response", {"etag": '"v1"', "content-type": "text/html", "date": "d1"}, "one"),
        (2, u + "/", 20, "revisit", {"etag": 'W/"v1"', "date": "d2", "content-length": "0", "expires": None}, None),
        (3, u, 30, "response", {"last-modified": "m3"}, "three"),
        (4, u, 40, "revisit", {"last-modified": "m3", "cache-control": "no"}, None),
        (5, u, 41, "revisit", {"etag": '"v1"'}, None),
        (6, "http://b.example", 5, "revisit", {"etag": "x"}, None),
        (7, u, 5, "revisit", {"etag": '"v1"'}, None),
        (8, None, 50, "revisit", None, None),
        (9, u, 300_000, "revisit", {"last-modified": "m3"}, None),
        (10, u, None, "revisit", None, None),
        (11, u, 30, "revisit", {"last-modified": "m3"}, None),
        (11, u, 30, "revisit", {"last-modified": "m3"}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as status", "3 as found")
    for width in (86_400, 7):
        out = m.resolve_revisits(df, width).collect()
        assert len(out) == 10
        got = {r.record_id: r for r in out}
        assert {i: (r.status, r.response_id, r.payload) for i, r in got.items()} == {
            2: ("resolved", 1, "one"), 4: ("resolved", 3, "three"), 5: ("mismatch", 3, None), 6: ("no_response", None, None), 7: ("no_response", None, None),
            8: ("no_response", None, None), 9: ("resolved", 3, "three"), 10: ("no_response", None, None), 11: ("resolved", 3, "three"),
        }
        assert got[2].headers == {"etag": 'W/"v1"', "content-type": "text/html", "date": "d2"}
    assert m.resolve_revisits(df.limit(0)).count() == 0


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet'")
    want = con.sql(m.OP4_SQL)
    cols = want.columns
    got = m.op4_warc_revisits(spark, d).select(*cols).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key) and got
