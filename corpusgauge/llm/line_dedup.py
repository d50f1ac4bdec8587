"""Drop a site's boilerplate lines by their frequency among the site's pages.

Pages are cut into text lines at block tags and line ends.  For every host the pages
that hold a line are counted and divided by the host's pages; lines above ``ratio`` that
two pages at least hold are dropped from all pages of the host, on every place they stand.

A host may have a third of all pages.  Counts are combined before their shuffle, and the
pages of a host are dealt over ``SALTS`` keys, for which its boilerplate lines are copied:
a host has no more of these than lines of a page on average divided by ``ratio``.

A null html has no lines, a null or odd url has the host ''.  Repeated pages count as
pages.  A line at exactly ``ratio`` stays.  A page may lose all its lines; it stays, with
empty text.  Very long pages are one text in one row.  An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.session import stored

RATIO = 0.3
#: Keys that the pages of one host are dealt over.
SALTS = 16

# Patterns that Java and RE2 read alike.
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer"
    r"|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot"
    r"|th|thead|title|tr|ul)\b[^>]*>"
)
TAG = r"(?s)<[a-zA-Z/!?][^>]*>"
BLANKS = r"[\x20\x09\x0B-\x0D]+"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def lines_of(html: Column) -> Column:
    """The text lines of a page, blanks put together, empty ones left out."""
    text = F.coalesce(html, F.lit(""))
    for pattern, to in ((COMMENT, ""), (SCRIPT, "\n"), (STYLE, "\n"), (BLOCK, "\n"), (TAG, ""), (BLANKS, " ")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def frequent_lines(lines: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``site, frequent``: hashes of each host's boilerplate lines, of ``lines(host, marks)``.

    A host has at most (lines of a page on average) / ``ratio`` of them, so the array is
    bounded however many pages the host has.
    """
    pages = lines.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "site")
    holding = lines.select("host", F.explode(F.array_distinct("marks")).alias("mark")).groupBy("host", "mark")
    holding = holding.agg(F.count(F.lit(1)).alias("holding")).filter("holding >= 2")
    often = holding.join(pages, F.col("host") == F.col("site")).filter(F.col("holding") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.collect_set("mark").alias("frequent"))


def without_boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of every row of ``pages``."""
    lines = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    # cut once: all later steps read the lines
    lines = stored(lines, "lines", "zstd")
    marked = lines.select("host", F.transform("lines", lambda x: F.xxhash64(x)).alias("marks"))
    often = frequent_lines(marked, ratio).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(SALTS)).cast("int"))
    met = dealt.join(often, (F.col("host") == F.col("site")) & (F.col("salt") == F.col("deal")), "left")
    none = F.array().cast("array<bigint>")
    frequent = F.coalesce(F.col("frequent"), none)
    kept = F.filter("lines", lambda x: ~F.array_contains(frequent, F.xxhash64(x)))
    cut = met.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.explode(F.array(kept)).alias("kept"))
    return cut.select(
        "page_id",
        "host",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
