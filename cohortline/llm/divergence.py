"""Source divergence audit: how far the word shares of a language's sources lie apart, and which words set a source off.

Count vectors as of a CountVectorizer per language, with a least document frequency and no limit to the vocabulary, for all
languages at once. They are built in Arrow tasks: Spark's own CountVectorizer took twice the time this operator may take, as
its fit moves a pair of objects per document and term, and its model a string per word.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import durable, ship

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTHING = 5
TOP_TERMS = 50
#: Terms that the driver numbers and Spark broadcasts at a time; more are dealt to several such vocabularies.
VOCABULARY = 1 << 20
#: Terms whose documents a task counts, and entries of vectors that it gathers, before it passes their sums on.
TASK_TERMS, TASK_CELLS = 60_000, 1 << 20
#: Sources and terms that meet in one task.
BLOCK_SOURCES, BLOCK_TERMS = 64, 1 << 14
#: Of ASCII, letters in lower case and a space for everything else; bytes from 0x80 on stay.
_FOLDED = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def _terms(text: bytes) -> list[bytes]:
    """Runs of letters and of all beyond ASCII, only A-Z lower-cased, in order and with repeats."""
    return text.translate(_FOLDED).split()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents that hold a term, summed in the task as far as its table of terms stays small."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def taken():
        for lang, held in counts.items():
            terms = pa.array(list(held), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), terms, pa.array(list(held.values()), pa.int64())], ["lang", "term", "n"])
        counts.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            counts[lang.as_py()].update(set(_terms(text.as_py())))
            if sum(map(len, counts.values())) > TASK_TERMS:
                yield from taken()
    yield from taken()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang and term of all terms that so many documents of the language hold. Every row is a document."""
    texts = docs.select(docs["text"].cast("binary").alias("text"), "lang")
    counts = texts.mapInArrow(_document_counts, "lang string, term binary, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", F.col("term").cast("string").alias("term"))


def _document_vectors(known: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """Of every document its language, source, and sparse vector: numbers of the kept terms in it, ascending, and their counts."""
    numbers = known.value
    for batch in batches:
        for text, lang, source in zip(batch.column("text"), batch.column("lang"), batch.column("source")):
            of_term = numbers.get(lang.as_py(), {}).get
            found = [n for n in map(of_term, _terms(text.as_py())) if n is not None]
            yield lang.as_py(), source.as_py(), *np.unique(np.array(found, np.int64), return_counts=True)


def _vector_sums(known: Broadcast):
    """Sums of the vectors by language and source, one row per term that occurs, summed in the task as far as they stay small."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], list] = defaultdict(list)
        held = 0

        def taken():
            for (lang, source), vectors in groups.items():
                terms, place = np.unique(np.concatenate([t for t, _ in vectors]), return_inverse=True)
                counts = np.zeros(len(terms), np.int64)
                np.add.at(counts, place, np.concatenate([c for _, c in vectors]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                                                  pa.array(terms), pa.array(counts)], ["lang", "source", "term_no", "n"])
            groups.clear()

        for lang, source, terms, counts in _document_vectors(known, batches):
            groups[lang, source].append((terms, counts))
            held += len(terms)
            if held > TASK_CELLS:
                yield from taken()
                held = 0
        yield from taken()

    return summed


def source_counts(docs: DataFrame, kept: DataFrame, vocabulary: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """How often each source has the kept terms (lang, source, term_no, n), and their numbers (lang, term_no, term).

    Each document becomes an exact sparse vector over the kept terms of its language, and vectors are summed by language and
    source. More terms than ``vocabulary`` are dealt to several vocabularies of some that size, each with vectors of its own.
    """
    spark = docs.sparkSession
    parts = max(1, -(-kept.count() // vocabulary))
    texts = docs.select(docs["text"].cast("binary").alias("text"), "lang", "source")
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("lang", "term"), F.lit(parts)))
    sums, names = [], []
    for part in range(parts):
        mine = dealt.filter(F.col("part") == part).select("lang", "term").toPandas()
        mine["term_no"] = np.arange(len(mine), dtype=np.int64) * parts + part
        numbers = {lang: dict(zip((t.encode() for t in of.term), of.term_no.tolist())) for lang, of in mine.groupby("lang")}
        known = spark.sparkContext.broadcast(numbers)
        cells = texts.mapInArrow(_vector_sums(known), "lang string, source string, term_no long, n long")
        sums.append(durable(cells.groupBy("lang", "source", "term_no").agg(F.sum("n").alias("n"))))
        names.append(spark.createDataFrame(mine, "lang string, term string, term_no long"))
    return reduce(DataFrame.unionAll, sums), durable(reduce(DataFrame.unionAll, names))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exact; null without terms."""
    over = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.call_function("div", over, F.nullif(under, F.lit(0).cast("decimal(20,0)"))) + 1


def _apart(rows: pd.DataFrame) -> pd.DataFrame:
    """Of every two sources of two blocks: the distance over the terms that occur in either block, less the distance of terms
    that neither has, for each of these terms. Rows with a negative place say what share an absent term has in their source."""
    heads = rows[rows["at"] < 0]
    sources = heads.source.to_numpy()
    absent = heads.p.to_numpy(np.int64)
    place = {s: i for i, s in enumerate(sources)}
    cells = rows[rows["at"] >= 0]
    seen, column = np.unique(cells["at"].to_numpy(), return_inverse=True)
    shares = np.repeat(absent[:, None], len(seen), axis=1)
    shares[cells.source.map(place).to_numpy(np.int64), column] = cells.p.to_numpy(np.int64)
    a, b = int(rows.a.iloc[0]), int(rows.b.iloc[0])
    block = heads.block.to_numpy()
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    out = []
    for i in left:
        d = np.abs(shares[right] - shares[i]).sum(axis=1) - len(seen) * np.abs(absent[right] - absent[i])
        other = sources[right] != sources[i]
        out.append(pd.DataFrame({"source": sources[i], "item": sources[right][other], "part_sum": d[other]}))
        if a != b:
            out.append(pd.DataFrame({"source": sources[right], "item": sources[i], "part_sum": d}))
    found = pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "part_sum": []})
    found.insert(0, "lang", rows.lang.iloc[0])
    return found


def pair_distances(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item, value for every two different sources of a language, both ways round.

    ``groups``: lang, source, n_sources and n_terms of the language, absent (the share of a term that does not occur);
    ``cells``: lang, source, term_no, p of those that do. Blocks of sources meet in pairs, a slice of the terms at a time, so
    that a task holds at most two blocks by a slice; terms that are absent from both blocks enter by their number only.
    """
    blocks = F.ceil(F.col("n_sources") / BLOCK_SOURCES)
    slices = F.greatest(F.ceil(F.col("n_terms") / BLOCK_TERMS), F.lit(1))
    placed = groups.select("lang", "source", "absent", "n_terms", F.pmod(F.xxhash64("source"), blocks).alias("block"), blocks.alias("blocks"), slices.alias("slices"))
    heads = placed.select("lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"),
                          F.lit(-1).cast("long").alias("at"), F.coalesce("absent", F.lit(0)).alias("p"))
    where = placed.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "block", "blocks", "slices")
    held = cells.join(where, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    held = held.select("lang", "source", "block", "blocks", F.pmod("term_no", "slices").alias("slice"), F.col("term_no").alias("at"), "p")
    met = heads.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("lang", "source", "block", "slice", "at", "p", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    sums = met.groupBy("lang", "a", "b", "slice").applyInPandas(_apart, "lang string, source string, item string, part_sum long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("part_sum"))
    one = placed.select(F.col("lang").alias("_l1"), F.col("source").alias("_s1"), F.col("absent").alias("z1"), "n_terms")
    two = placed.select(F.col("lang").alias("_l2"), F.col("source").alias("_s2"), F.col("absent").alias("z2"))
    both = sums.join(one, (F.col("lang") == F.col("_l1")) & (F.col("source") == F.col("_s1"))).join(
        two, (F.col("lang") == F.col("_l2")) & (F.col("item") == F.col("_s2")))
    rest = F.coalesce(F.col("n_terms") * F.abs(F.col("z1") - F.col("z2")), F.lit(0))
    return both.select("lang", "source", "item", (F.col("part_sum") + rest).alias("value"))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
                      top_terms: int = TOP_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows give the distance to each other source of the language, ``term`` rows
    the terms with the largest excess over the language's share.

    A language keeps the terms that ``min_docs`` of its documents hold; shares are over these. Nulls in the three columns are
    empty texts, languages and sources. Every row is a document, repeated ones too. Ties are ranked by item. A language without
    kept terms has distances 0; a source alone in its language has no pair rows; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    given = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    sums, names = source_counts(given, durable(kept_terms(given, min_docs)), vocabulary)

    sizes = names.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms")).select(F.col("lang").alias("_lang"), "n_terms")
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total")).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "total")
    groups = given.select("lang", "source").distinct()
    groups = groups.join(totals, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left").join(sizes, F.col("lang") == F.col("_lang"), "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    groups = durable(groups.withColumn("absent", share(F.lit(0), F.col("total"), F.col("n_terms"))))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("total").alias("lang_total")).withColumnRenamed("lang", "_lang")
    groups = groups.join(langs, F.col("lang") == F.col("_lang")).drop("_lang")

    facts = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "total", "n_terms", "lang_total")
    cells = sums.join(facts, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).select(
        "lang", "source", "term_no", "n_terms", "lang_total", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"))
    pairs = pair_distances(groups, cells)

    whole = sums.groupBy("term_no").agg(F.sum("n").alias("lang_n")).withColumnRenamed("term_no", "_no")
    whole = whole.join(names, F.col("_no") == F.col("term_no")).select("_no", "lang_n", F.col("term").alias("item"))
    excess = cells.join(whole, F.col("term_no") == F.col("_no")).select(
        "lang", "source", "item", (F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
              for name, df in (("pair", pairs), ("term", excess))]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top_terms))
