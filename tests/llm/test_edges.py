"""All registered operators over tables with nulls, repeats, blanks and extra columns, and over empty ones."""

import pytest

from sparkvane.llm import registry

QUERIES = registry.queries()
ROWS = [
    (1, "the cat sat on a mat and then the dog ran far away", "en", "s", 50), (1, "the cat sat on a mat and then the dog ran far away", "en", "s", 50), (1, "another text under the same id", None, None, None),
    (None, "der Hund und die Katze im Haus", "de", "s", 30), (None, None, None, None, None), (2, None, "de", "s", 0), (3, "", "en", None, 0), (4, " \n\t ", "en", "s", 3), (5, "x", None, "s", 1),
    (6, "word " * 30000, "en", "s", 150000), (7, "é" * 5000, "fr", "s", 5000), (8, "mail a@b.co token=abcdefghijklmnop 10.0.0.1 +1 (988) 555-2485", "en", "s", 60), (9, "\x00\x7f\x80￾ 漢字 😀", "en", "s", 9),
]


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as fp", "1 as row", "2 as g", "3 as blob", "4 as length", "5 as held_out", "6 as spans")
    pages = spark.createDataFrame([(1, "http://a.example/x", "<html lang=\"en\">1"), (2, "http://a.example/x?utm_source=feed", "<html lang=\"en\">2"), (2, "http://a.example/x?utm_source=feed", "<html lang=\"en\">2"), (3, None, None), (None, "http://b.example/?utm_source=q", None)], "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as at", "3 as kind")
    bench = spark.createDataFrame([(1, "the cat sat on a mat and then the dog ran far"), (None, "x"), (3, None), (4, "")], "item_id long, text string").selectExpr("*", "1 as i", "2 as t")
    for name, d in (("documents", docs), ("pages", pages), ("benchmark", bench)):
        d.write.parquet(str(full / f"{name}.parquet"))
        d.limit(0).write.parquet(str(empty / f"{name}.parquet"))
    return str(full), str(empty)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edges(spark, dirs, name):
    full, empty = dirs
    out = QUERIES[name](spark, full)
    rows = out.collect()
    if name.startswith("op4_"):
        assert {(r.page_id, r.status) for r in rows} == {(2, "resolved"), (None, "no_response")} and len(rows) == 3
    else:
        ids = [r.doc_id for r in rows if "piece" not in out.columns or r.piece == 0]
        key = lambda i: (i is None, i or 0)
        assert sorted(ids, key=key) == sorted((r[0] for r in ROWS), key=key)
    none = QUERIES[name](spark, empty)
    assert none.count() == 0 and none.columns == out.columns
