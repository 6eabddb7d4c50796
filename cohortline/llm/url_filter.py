"""URL filters by Bloom filter cascades: exact membership over the corpus's keys, without joins at lookup."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import durable, ship

BITS_PER_KEY = 10
PROBES = 7
#: Listed keys of one cascade, which bounds what is broadcast (some 12 MB); longer lists become several cascades.
KEYS_PER_CASCADE = 1 << 22
_SEEDS = 0x9E3779B97F4A7C15


@dataclass
class Level:
    words: np.ndarray  # the bits, in words of 64
    size: int
    seed: int


@dataclass
class Cascade:
    """Levels in turn encode listed keys and what the level before lets through wrongly, until nothing is wrong."""

    levels: list[Level]

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether keys, given as two hashes each, are listed; exact for keys of the universe."""
        listed = np.zeros(len(first), bool)
        going = np.arange(len(first))
        for depth, level in enumerate(self.levels):
            going = going[passes(level, first[going], second[going])]
            if depth % 2 == 0:
                listed[going] = True
            else:
                listed[going] = False
        return listed


def _places(level: Level, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """PROBES bit numbers of each key, one row per probe; every level mixes anew."""
    with np.errstate(over="ignore"):
        a = (first.view(np.uint64) ^ np.uint64(level.seed)) * np.uint64(0xFF51AFD7ED558CCD)
        a ^= a >> np.uint64(33)
        b = (second.view(np.uint64) + np.uint64(level.seed)) * np.uint64(0xC4CEB9FE1A85EC53)
        b = (b ^ (b >> np.uint64(29))) | np.uint64(1)
        probes = np.arange(PROBES, dtype=np.uint64)[:, None]
        return (a + probes * b) % np.uint64(level.size)


def passes(level: Level, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    places = _places(level, first, second)
    return ((level.words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(axis=0)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _level(keys: DataFrame, count: int, depth: int) -> Level:
    """The filter of ``_a``, ``_b``: bits are gathered per task, merged by word, and only words are collected."""
    level = Level(np.zeros(0, np.uint64), max(64, BITS_PER_KEY * count), (depth + 1) * _SEEDS % (1 << 64))

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places = np.unique(_places(level, frame["_a"].to_numpy(), frame["_b"].to_numpy()))
            word, at = np.unique(places >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), at)
                yield pd.DataFrame({"_word": word.view(np.int64), "_bits": value.view(np.int64)})

    found = keys.select("_a", "_b").mapInPandas(bits, "_word long, _bits long")
    merged = found.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).toPandas()
    level.words = np.zeros(level.size // 64 + 1, np.uint64)
    level.words[merged["_word"].to_numpy(dtype=np.int64)] = merged["_bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return level


def _filtered(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def let_through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[passes(shared.value, frame["_a"].to_numpy(), frame["_b"].to_numpy())]

    return keys.select("_a", "_b").mapInPandas(let_through, "_a long, _b long")


def build(universe: DataFrame, listed: DataFrame, keys_per_cascade: int = KEYS_PER_CASCADE) -> list[Cascade]:
    """Cascades that tell the listed keys of ``universe``; both have one string column of keys.

    The universe must hold every key that will be asked for. Keys are 128-bit hashes. Part p of n has the keys whose
    first hash leaves p modulo n; usually there is one part.
    """
    def keys(df: DataFrame) -> DataFrame:
        a, b = _hashes(F.col(df.columns[0]))
        return df.filter(F.col(df.columns[0]).isNotNull()).select(a.alias("_a"), b.alias("_b")).distinct()

    everything = keys(universe)
    named = keys(listed).withColumn("_listed", F.lit(True))
    marked = durable(everything.join(named, ["_a", "_b"], "left"))
    total = marked.filter("_listed").count()
    parts = max(1, -(-total // keys_per_cascade))
    cascades = []
    for part in range(parts):
        own = marked.filter(F.pmod("_a", F.lit(parts)) == part)
        inside, outside = own.filter("_listed").select("_a", "_b"), own.filter("_listed IS NULL").select("_a", "_b")
        levels: list[Level] = []
        count = inside.count()
        while count:
            level = _level(inside, count, len(levels))
            levels.append(level)
            wrong = durable(_filtered(outside, level))
            inside, outside, count = wrong, inside, wrong.count()
        cascades.append(Cascade(levels))
    return cascades


def first_listed(spark: SparkSession, keys: Column, cascades: list[Cascade], part: int) -> Column:
    """The position, from 0, of the first listed of an array of keys; null if none is."""
    shared = spark.sparkContext.broadcast((cascades[part], part, len(cascades)))

    @F.pandas_udf("int")
    def position(first: pd.Series, second: pd.Series) -> pd.Series:
        cascade, own, parts = shared.value
        sizes = np.array([len(x) for x in first])
        if not sizes.sum():
            return pd.Series([None] * len(first), dtype="Int32")
        a = np.concatenate([np.asarray(x, np.int64) for x in first])
        b = np.concatenate([np.asarray(x, np.int64) for x in second])
        hit = cascade.holds(a, b) & (a % parts == own)
        out, at = [], 0
        for n in sizes:
            here = np.flatnonzero(hit[at:at + n])
            out.append(int(here[0]) if len(here) else None)
            at += n
        return pd.Series(out, dtype="Int32")

    a, b = F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1])
    return position(a, b)


def _least_position(df: DataFrame, keys: str, cascades: list[Cascade], name: str) -> DataFrame:
    """One pass for each part, so that a Python worker holds one part's filters; nearly always there is one."""
    for part in range(len(cascades)):
        found = first_listed(df.sparkSession, F.col(keys), cascades, part)
        df = df.withColumn(name, F.least(F.col(name), found) if part else found)
        if len(cascades) > 1:
            df = durable(df)
    return df


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased. Path: then up to ? or #. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and the domains above it, longest first."""
    labels = F.split(host, "\\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id",
               url: str = "url") -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` are (allow or block, host, path), a short list; a rule fits its host and subdomains if the path starts with
    its path; the longest (host and path together) wins, a block rule before an allow rule as long. Pages without
    a rule are blocked exactly if ``listed``, one column of hosts, has their host or a domain above it. A null url has
    empty host and path, no rule, and is allowed unless the empty host is listed. Repeated rows are judged alike.

    The universe of the cascades is every (domain, path prefix) of the corpus, so membership is exact.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = host_and_path(pages[url])
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    base = pages.select(pages[id_col].alias(id_col), host.alias("host"), path.alias("path")).withColumn("_domains", _suffixes(F.col("host")))
    long_enough = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    prefixed = F.flatten(F.transform("_domains", lambda d: F.transform(
        long_enough, lambda n: F.concat(d, F.lit("\n"), F.substring(F.col("path"), F.lit(1), n)))))
    base = base.withColumn("_keys", F.reverse(F.array_sort(prefixed, lambda x, y: F.length(x) - F.length(y))))

    def member(df: DataFrame, keys: str, wanted: DataFrame, name: str) -> DataFrame:
        universe = base.select(F.explode(keys).alias("_key")).distinct()
        return _least_position(df, keys, build(universe, wanted), name)

    def rule_keys(kind: str) -> DataFrame:
        return spark.createDataFrame([(f"{h}\n{p}",) for k, h, p in rules if k == kind], "key string")

    out = base
    for kind in ("allow", "block"):
        out = member(out, "_keys", rule_keys(kind), f"_{kind}")
    out = member(out, "_domains", listed, "_listed")
    allow, block = (F.get(F.col("_keys"), F.col(f"_{k}")) for k in ("allow", "block"))
    blocked = F.coalesce(F.length(block) >= F.length(allow), block.isNotNull())
    rule = F.when(blocked, block).otherwise(allow)
    verdict = (F.when(rule.isNotNull(), F.when(blocked, "block").otherwise("allow"))
               .otherwise(F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")))
    return out.select(id_col, "host", "path", F.replace(rule, F.lit("\n"), F.lit("")).alias("rule"), verdict.alias("verdict"))
