"""Quality rules: base rules on words, and cross-document line frequency within a host."""

from __future__ import annotations


import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import durable, pack_row, ship, unpack_row

#: A line is removed if it is in more than this share of its host's documents ...
MAX_SHARE = 0.1
#: ... and in at least so many of them.
MIN_DOCS = 20
#: A document that keeps less than this share of its words is depleted.
MIN_LEFT = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_NOT_STARTS = bytes(range(0x80, 0xC0))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _line_keys(text: bytes) -> tuple[list[int | None], list[int]]:
    """Hash and number of words of each line; A-Z lower-cased, words single-spaced; a line without words has no hash."""
    words = [line.split() for line in text.lower().split(b"\n")]
    keys = [xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) if w else None for w in words]
    return keys, [len(w) for w in words]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by runs of ``window`` words that are found at least twice, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[tuple, int] = {}
    seen = first.setdefault
    hits = set()
    for i, w in enumerate(zip(*[words[k:] for k in range(window)])):
        j = seen(w, i)
        if j != i:
            hits.add(j)
            hits.add(i)
    covered, end = 0, 0
    for i in sorted(hits):
        covered += i + window - max(i, end)
        end = i + window
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = _bytes(text)
    words = raw.split()
    solid = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(solid.translate(None, _NOT_STARTS)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measured(text: Column) -> Column:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_keys", "_sizes"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names[:5]) + ", _keys array<long>, _sizes array<int>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*base_counts(t), *_line_keys(_bytes(t))) for t in texts], columns=names)

    return measured(text)


def _keys_of(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([_line_keys(_bytes(t))[0] for t in texts])

    return keys(text)


def frequent_lines(rows: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """``_host`` and ``_drop`` from documents of ``_at`` and ``_keys``: hashes of the lines above the limits.

    A document counts once for each line. Counts are summed map-side. The list of a host is bounded: each of its lines is in
    more than max_share of the documents, so there are at most (mean lines of a document) / max_share.
    """
    totals = rows.groupBy(F.col("_at").alias("_host")).agg(F.count(F.lit(1)).alias("_docs"))
    counts = (
        rows.select(F.col("_at").alias("_host"), F.explode(F.array_distinct(F.array_compact("_keys"))).alias("_key"))
        .groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_with"))
        .filter(F.col("_with") >= min_docs)
    )
    return (
        counts.alias("c").join(totals.alias("t"), F.col("c._host").eqNullSafe(F.col("t._host")))
        .filter(F.col("_with") > max_share * F.col("_docs"))
        .groupBy(F.col("c._host").alias("_host")).agg(F.collect_list("_key").alias("_drop"))
    )


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per document: rows of one id, host and lines are the same one; a row without an id is one of its own."""
    alone = F.when(F.col("_doc").isNull(), F.monotonically_increasing_id())
    return rows.select("_at", "_doc", alone.alias("_alone"), "_keys").distinct()


def line_quality(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text",
                 max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: its id, the base counts, ``base_failed``, ``left_words`` and ``kept``.

    A null text counts as empty (and fails the base rules); null hosts are one host. Rows of one id with the same lines count
    as one document for the limits, and each gets a row; rows without an id are documents of their own. A document is kept if it passes the base rules and, without the lines that are too frequent in its
    host, still has ``min_left`` of its words; exactly that share is enough. Texts are read once: counts and line
    hashes, much shorter than they, are written to the shared folder for the two steps that follow.
    """
    ship(docs.sparkSession)
    rows = durable(docs.select(docs[id_col].alias("doc_id"), docs[host].alias("_at"), _measured(docs[text]).alias("_q"))
                   .select("doc_id", "_at", "_q.*"))
    bad = frequent_lines(_distinct(rows.withColumnRenamed("doc_id", "_doc")), max_share, min_docs)
    found = rows.join(bad, F.col("_at").eqNullSafe(F.col("_host")), "left")
    sizes = F.zip_with("_keys", "_sizes", lambda k, n: F.when(F.array_contains(F.col("_drop"), k), n).otherwise(0))
    gone = F.when(F.col("_drop").isNull(), 0).otherwise(F.aggregate(sizes, F.lit(0), lambda a, x: a + x))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - gone
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), left.alias("left_words"),
                        (~failed & (left >= min_left * F.col("n_words"))).alias("kept"))


def without_frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", max_share: float = MAX_SHARE,
                           min_docs: int = MIN_DOCS, id_col: str = "doc_id") -> DataFrame:
    """All columns of every row, ``text`` without the lines that are above the limits in the row's host; null stays null.

    Documents are told apart as by line_quality().
    """
    ship(docs.sparkSession)
    keys = _keys_of(docs[text])
    documents = docs.select(docs[host].alias("_at"), docs[id_col].alias("_doc"), keys.alias("_keys"))
    bad = frequent_lines(_distinct(documents), max_share, min_docs)
    packed = pack_row(docs, at=docs[host], text=docs[text], keys=keys)
    joined = packed.join(bad, F.col("_at").eqNullSafe(F.col("_host")), "left")
    kept = F.filter(F.split("_text", "\n", -1),
                    lambda x, i: ~F.coalesce(F.array_contains(F.col("_drop"), F.get(F.col("_keys"), i)), F.lit(False)))
    cleaned = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return unpack_row(joined, docs.columns, **{text: cleaned})
