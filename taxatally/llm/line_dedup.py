"""Lines dropped by how often they stand on the pages of their site.

A line is boilerplate of a host if more than ``ratio`` of the host's pages hold it, and at
least ``least`` do. Pages are counted by content: pages of a host with the same text count
once, so copies of a page don't make its lines boilerplate. Near copies do, unless the caller
says by ``families`` which texts are one: then pages of a family count once, in the pages of the
host and in those that hold a line. Lines are compared without blanks at either end; empty lines
are never dropped. Built-in functions only.

A host has at most (mean distinct lines of a page) / ``ratio`` boilerplate lines, so their list
fits one row per host. A null host is a host of its own. A null text stays null; a text of
which all lines go becomes empty. Repeated rows are treated alike; an empty table gives an empty
result. Extra columns stay as they are; ``text`` is replaced in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import fresh

RATIO, LEAST = 0.1, 3

#: What has no visible text, and the tags at which a browser starts a new line.
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:address|article|aside|body|br|div|dd|dl|dt|footer|form|h[1-6]|head|header|html|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>"
TAGS = r"<[^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)"


def page_text(html: Column) -> Column:
    """The lines of a page: hidden parts out, block tags as line ends, other tags out."""
    out = F.regexp_replace(html, HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(out, BREAKS, "\n"), TAGS, "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, families: DataFrame | None = None) -> DataFrame:
    """``host, lines``: hashes of the boilerplate lines of each host that has any.

    ``docs`` has ``host`` and ``text``. ``families`` has one row ``page, family`` for each text
    (``page`` is its xxhash64) that counts as one with others; texts it doesn't have stand for
    themselves. Counts are exact and cover all rows.
    """
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    pages = docs.filter("text is not null").select("host", F.xxhash64("text").alias("page"), keys.alias("lines"))
    pages = pages.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    if families is not None:
        pages = pages.join(families, "page", "left").select("host", F.coalesce("family", "page").alias("page"), "lines")
    # The null line stands for the page itself and so counts the pages of the host.
    marked = pages.select("host", "page", F.explode(F.array_union(F.array(F.lit(None).cast("long")), "lines")).alias("line"))
    marked = marked.select("host", "line") if families is None else marked.distinct()
    counts = marked.groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = stored(counts.filter((F.col("n") >= least) | F.col("line").isNull()), "line_counts")
    totals = counts.filter("line is null").select(F.col("host").alias("_host"), F.col("n").alias("pages"))
    often = counts.filter("line is not null").join(totals, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, least: int = LEAST, families: DataFrame | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines of each row's host cut from ``text``."""
    site, cut = fresh(docs, "site", "cut")
    bad = stored(boilerplate(docs.select(host.alias("host"), "text"), ratio, least, families), "boilerplate")
    bad = bad.select(F.struct("host").alias(site), F.col("lines").alias(cut))
    marked = docs.withColumn(site, F.struct(host.alias("host")))
    kept = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(cut, F.xxhash64(F.trim(x))) | (F.trim(x) == ""))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = marked.join(bad, site, "left")
    return joined.select(*((text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns))


def pages(docs: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``page_id, host, n_lines, n_kept, text`` of every row of ``page_id, url, html``.

    The two counts are of lines that aren't empty, before and after.
    """
    full = lambda c: F.size(F.filter(_lines(F.col(c)), lambda x: F.trim(x) != "")).cast("long")
    rows = docs.select("page_id", host_of(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    rows = rows.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), full("text")), F.lit(0).cast("long")))
    out = drop_boilerplate(rows, F.col("host"), ratio, least)
    return out.select("page_id", "host", "n_lines", F.coalesce(F.when(F.col("text").isNotNull(), full("text")), F.lit(0).cast("long")).alias("n_kept"), "text")


def pages_sql(ratio: float = RATIO, least: int = LEAST) -> str:
    """What ``pages`` gives, as SQL over the table ``pages``."""
    return rf"""
    WITH rows AS (
        SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
               regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g') AS text
        FROM pages),
    numbered AS (SELECT *, row_number() OVER () AS row_no FROM rows),
    cut AS (SELECT row_no, page_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
            FROM numbered WHERE text IS NOT NULL),
    totals AS (SELECT host, count(DISTINCT text) AS pages FROM rows WHERE text IS NOT NULL GROUP BY host),
    often AS (SELECT c.host, trim(line) AS line FROM cut c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE trim(line) <> ''
              GROUP BY c.host, trim(line), t.pages HAVING count(DISTINCT text) >= {least} AND count(DISTINCT text) > {ratio}::DOUBLE * t.pages),
    marked AS (SELECT c.*, o.line IS NOT NULL AS bad FROM cut c LEFT JOIN often o ON c.host IS NOT DISTINCT FROM o.host AND trim(c.line) = o.line),
    joined AS (SELECT row_no, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE trim(line) <> '' AND NOT bad) AS n_kept,
                      coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT bad), '') AS text FROM marked GROUP BY row_no)
    SELECT n.page_id, n.host, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_kept, 0) AS n_kept, j.text
    FROM numbered n LEFT JOIN joined j USING (row_no)"""
