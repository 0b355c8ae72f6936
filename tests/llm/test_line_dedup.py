"""Line dedup against plain counting, and against SQL over the pages."""

from collections import defaultdict

from oracle import database, difference
from pyspark.sql import functions as F

from taxatally.llm import line_dedup


def brute(rows, ratio, least):
    pages, held = defaultdict(set), defaultdict(set)
    for host, text in rows:
        if text is not None:
            pages[host].add(text)
            for line in text.split("\n"):
                held[host, line.strip(" ")].add(text)
    out = []
    for host, text in rows:
        if text is None:
            out.append((host, None))
            continue
        bad = lambda x: x.strip(" ") != "" and len(held[host, x.strip(" ")]) >= least and len(held[host, x.strip(" ")]) > ratio * len(pages[host])  # noqa: B023, E731
        out.append((host, "\n".join(x for x in text.split("\n") if not bad(x))))
    return sorted(out, key=repr)


def test_small(spark):
    rows = []
    for i in range(60):
        host = ["a", "b", None, "", "é"][i % 5]
        lines = [f"own {i}", "  on all pages ", f"of some {i % 3}", "", f"rare {i % 12}", "\tkept tab"]
        rows.append((host, "\n".join(lines)))
    rows += [rows[0]] * 30 + [("one", "alone\nalone"), ("a", None), ("a", ""), ("b", "on all pages"), ("long", "x" * 100_000 + "\n" + "y " * 100_000)]
    for ratio, least in ((0.1, 3), (0.3, 2), (0.0, 1), (0.9, 3)):
        docs = spark.createDataFrame([(h, t, 1, "z") for h, t in rows], "source string, text string, host int, lines string")
        out = line_dedup.drop_boilerplate(docs, F.col("source"), ratio, least)
        assert out.columns == docs.columns and {(r.host, r.lines) for r in out.collect()} == {(1, "z")}
        assert sorted(((r.source, r.text) for r in out.collect()), key=repr) == brute(rows, ratio, least)


def test_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    for ratio, least in ((0.1, 3), (0.02, 2)):
        out = line_dedup.pages(pages, ratio, least)
        assert difference(out, database(folder), line_dedup.pages_sql(ratio, least)) is None
        assert out.filter("n_kept < n_lines").count() > 0


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no url", "<p>a<br>b"), (3, "HTTP://Ex.com:80/x", "<div\nclass=x>a</div>"), (4, "", ""), (4, "", ""), (None, "http://ex.com", "<script>x<p></script>c")]
    out = {(r.page_id, r.host, r.n_lines, r.text) for r in line_dedup.pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {(1, None, 0, None), (2, "", 2, "\na\nb"), (3, "ex.com", 1, "\na\n"), (4, "", 0, ""), (None, "ex.com", 1, "c")}


def test_empty_and_native(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    out = line_dedup.pages(pages)
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
