"""Line dedup by site-relative frequency: lines that too large a share of a site's pages contain are dropped.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import ASCII_SPACE, pack_row

#: A line on more than this share of its site's pages is boilerplate ...
MAX_RATIO = 0.1
#: ... if it is on at least so many of them: on a site of few pages a share says nothing.
MIN_PAGES = 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """A line without the white space around it, as 64 bits; null for blank lines, which are never counted."""
    bare = F.trim(line, F.lit(ASCII_SPACE))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host`` and ``_drop``, the keys of its boilerplate lines.

    A page counts once for each different line, before anything is shuffled; counts are summed map-side, so a host with
    a third of all pages sends a row per line and task. The list of a host is short: its lines are each on more than
    ``max_ratio`` of the pages, so there are at most (mean lines of a page) / max_ratio of them.
    """
    pages = docs.select(docs[host].alias("_host"), docs[text].alias("_text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    keys = F.array_distinct(F.array_compact(F.transform(_lines(F.col("_text")), _key)))
    counts = (
        pages.select("_host", F.explode(keys).alias("_key"))
        .groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_with"))
        .filter(F.col("_with") >= min_pages)
    )
    return (
        counts.alias("c").join(totals.alias("t"), F.col("c._host").eqNullSafe(F.col("t._host")))
        .filter(F.col("_with") > max_ratio * F.col("_pages"))
        .groupBy(F.col("c._host").alias("_host"))
        .agg(F.collect_list("_key").alias("_drop"))
    )


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO,
               min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of every row as struct ``row``, with ``text`` cleaned, and ``n_lines``, ``n_dropped``.

    Null hosts form one host. A null text has no line and stays null; a text whose lines all go becomes empty; its row
    stays. Blank lines are never dropped, and repeated rows count as pages of their own. Lines are compared without the
    ASCII white space around them, as 64-bit hashes: what could go wrongly is only a line that collides with one of the
    few boilerplate lines of its own host. Lines end at ``\\n``.
    """
    drop = boilerplate(docs, host, text, max_ratio, min_pages)
    packed = pack_row(docs, page_host=docs[host], text=docs[text])
    joined = packed.join(drop, F.col("_page_host").eqNullSafe(F.col("_host")), "left")
    lines = _lines(F.col("_text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), _key(x)), F.lit(False)))
    judged = joined.withColumn("_kept", F.when(F.col("_drop").isNull(), lines).otherwise(kept))
    cleaned = F.when(F.col("_text").isNotNull(), F.array_join("_kept", "\n"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return judged.select(
        F.struct(*[(cleaned if n == text else F.col("_row").getField(n)).alias(n) for n in docs.columns]).alias("row"),
        n_lines.alias("n_lines"),
        (n_lines - F.when(F.col("_text").isNull(), 0).otherwise(F.size("_kept"))).cast("long").alias("n_dropped"),
    )
