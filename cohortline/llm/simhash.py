"""SimHash near-dedup by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import durable, ship
from cohortline.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Fingerprints are cut into so many blocks of equal width.
BLOCKS = 4
#: Fingerprints of a block that are compared pair by pair; larger blocks are linked through shared neighbours.
PAIRED = 64
#: Hashes whose bits are counted at once, to bound memory on very long texts.
_CHUNK = 1 << 15


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text: bit i is set if it is in over half of the shingles' hashes."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        end = min(n, start + _CHUNK)
        some = parts[start:end + words - 1]
        joined = map(b" ".join, zip(*[some[i:] for i in range(words)])) if len(parts) >= words else [b" ".join(parts)]
        hashes = np.array([digest(x, 42) for x in joined], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a long (the same 64 bits, signed)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words) for t in texts], dtype="uint64").astype("int64")

    return of(text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _blocks(fp: Column, max_bits: int) -> Column:
    """Keys of all choices of BLOCKS - max_bits blocks: two fingerprints within max_bits share at least one."""
    width = 64 // BLOCKS
    keys = []
    for chosen in combinations(range(BLOCKS), BLOCKS - max_bits):
        mask = sum(((1 << width) - 1) << (width * i) for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(sum(1 << i for i in chosen)).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED) -> DataFrame:
    """Links (``a``, ``b``) whose components are those of "at most max_bits differing bits", for different ``_fp``.

    ``nodes`` has one row per fingerprint: ``_fp`` and its ``_node``. Blocks of at most ``paired`` fingerprints are joined with
    themselves and verified by Hamming distance. In a fuller block the number of pairs would grow with its square;
    there, every fingerprint names all points within max_bits / 2 of it, and two of them are within max_bits exactly if
    they share such a point (max_bits is 2 or less). A point has at most 65 fingerprints, whatever the input.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    keyed = nodes.select("_fp", "_node", F.explode(_blocks(F.col("_fp"), max_bits)).alias("_block"))
    sizes = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    shared = durable(keyed.join(sizes, "_block"))
    few = shared.filter(F.col("_size") <= paired)
    left = few.select("_block", F.col("_fp").alias("_x"), F.col("_node").alias("a"))
    right = few.select("_block", F.col("_fp").alias("_y"), F.col("_node").alias("b"))
    near = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))) <= max_bits
    by_pairs = left.join(right, (left["_block"] == right["_block"]) & (F.col("_x") < F.col("_y")) & near).select("a", "b")

    many = shared.filter(F.col("_size") > paired).select("_fp", "_node").distinct()
    flips = [(1 << i) - ((1 << 64) if i == 63 else 0) for i in range(64)]
    around = F.transform(F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in flips]),
                         lambda x: x.bitwiseXOR(F.col("_fp")))
    if max_bits == 2:
        points = many.select("_node", F.explode(around).alias("_point"))
    else:  # within 1 bit: the smaller of the two ends of each flip names the edge
        points = many.select("_node", F.explode(F.transform(
            F.array(*[F.lit(x).cast("long") for x in flips]),
            lambda x: F.struct(x.alias("flip"), F.least(F.col("_fp"), x.bitwiseXOR(F.col("_fp"))).alias("end")))).alias("_point"))
    met = points.groupBy("_point").agg(F.min("_node").alias("b"), F.collect_set("_node").alias("_all")).filter(F.size("_all") > 1)
    by_points = met.select(F.explode("_all").alias("a"), "b").filter("a <> b")
    return by_pairs.union(by_points)


def _groups(prints: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """``_fp`` and ``_first``, the least value of ``least`` in its group, for every fingerprint of ``prints``."""
    nodes = durable(prints.groupBy("_fp").agg(F.min(least).alias("_least"))
                    .select("_fp", "_least", F.monotonically_increasing_id().alias("_node")))
    linked = components(links(nodes, max_bits))
    member = nodes.join(linked, nodes["_node"] == linked["node"], "left").select(
        "_fp", "_least", F.coalesce("component", "_node").alias("_group"))
    first = member.groupBy("_group").agg(F.min("_least").alias("_first"))
    return member.join(first, "_group").select("_fp", "_first")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` of every row.

    A-Z is lower-cased, words are cut at ASCII white space, shingles hashed by XXH64 with seed 42. Null, empty and blank
    texts have fingerprint zero and link like any other. Rows with one fingerprint are one node, so groups of copies
    never form pairs; repeated rows come back as often as they were given. A component is named by its least id; rows
    without an id take part like others, and a component of such rows only has none.
    """
    ship(docs.sparkSession)
    prints = durable(docs.select(docs[id_col].cast("long").alias("doc_id"), fingerprints(docs[text], words).alias("_fp")))
    named = _groups(prints, F.col("doc_id"), max_bits)
    return prints.join(named, "_fp").select("doc_id", hex_digits(F.col("_fp")).alias("fingerprint"), F.col("_first").alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """All columns of one row of each group: that of the least id (rows without one come last), then of the least hash.

    Of repeated rows with that id and text one stays.
    """
    ship(docs.sparkSession)

    def name(of: DataFrame) -> list[Column]:
        return [F.xxhash64(of[text]).alias("_t"), F.xxhash64(of[id_col], F.lit("id"), of[text]).alias("_u")]

    prints = durable(docs.select(docs[id_col].alias("_id"), *name(docs), fingerprints(docs[text], words).alias("_fp")))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_t").alias("_t"), F.col("_u").alias("_u"))
    chosen = _groups(prints, order, max_bits).select("_first._t", "_first._u").distinct()
    packed = docs.select(F.struct("*").alias("_row"), *name(docs))
    return packed.join(chosen, ["_t", "_u"], "left_semi").dropDuplicates(["_t", "_u"]).select("_row.*")
