"""Exact top-k search by a pivot-distance index.

The largest inner product is the nearest vector once every vector v gets one more component, sqrt(M - |v|^2), and every
query a zero there (M: the largest squared norm). Each vector is keyed by its nearest pivot and its distance to it; vectors of one pivot
and one range of distances form an annulus. By the triangle inequality a vector of the annulus is no nearer to a query
than the query's distance to the pivot lies outside the annulus' range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import durable, ship

#: Pivots, spread over a sample of SAMPLE vectors (those of the least hashes); every vector is indexed.
PIVOTS = 32
SAMPLE = 2048
RINGS = 8
#: Vectors and queries that meet in one task at a time.
BLOCK = 2048
QUERY_BLOCK = 1024
_SLACK = 1e-9


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null if the vector is null or has a null or non-finite component.

    A component that no long holds after scaling fails the query.
    """
    whole = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def scaled(x: Column) -> Column:
        y = F.lit(float(scale)) * x
        return F.when(F.abs(y) < 2.0 ** 63, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    return F.when(embedding.isNotNull() & ~bad, F.transform(whole, scaled))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors get zeros, which change no product."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.stack([np.asarray(v, np.int64) for v in vectors])
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision where no partial sum can pass 2^53, in integers else.

    Sums that could pass 2^63 are formed of Python's integers; a product that no long holds fails.
    """
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1]
    if bound < 2 ** 53:
        return np.rint(queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if bound < 2 ** 62:
        return queries @ vectors.T
    wide = queries.astype(object) @ vectors.astype(object).T
    if np.abs(wide).max() >= 2 ** 63:
        raise OverflowError("an inner product does not fit a long")
    return wide.astype(np.int64)


def _squares(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return (m * m).sum(axis=1)


class Geometry:
    """Pivots in the lifted space, and the annuli with their ranges of distances."""

    def __init__(self, pivots: np.ndarray, most: float, edges: np.ndarray):
        self.pivots, self.most, self.edges = pivots, most, edges
        self.width = pivots.shape[1] - 1
        self.annuli = pd.DataFrame(columns=["_p", "_r", "n", "lo", "hi"])

    def _distances(self, m: np.ndarray, extra: np.ndarray) -> np.ndarray:
        lifted = np.concatenate([m.astype(np.float64), extra[:, None]], axis=1)
        square = (lifted * lifted).sum(1)[:, None] - 2 * lifted @ self.pivots.T + (self.pivots ** 2).sum(1)[None, :]
        return np.sqrt(np.maximum(square, 0))

    def of_vectors(self, m: np.ndarray) -> np.ndarray:
        return self._distances(m, np.sqrt(np.maximum(self.most - _squares(m), 0)))

    def of_queries(self, m: np.ndarray) -> np.ndarray:
        return self._distances(m, np.zeros(len(m)))

    def nearest_possible(self, m: np.ndarray) -> np.ndarray:
        """Per query and annulus, a distance below which no vector of the annulus can be."""
        d = self.of_queries(m)[:, self.annuli["_p"].to_numpy(dtype=int)]
        gap = np.maximum(self.annuli["lo"].to_numpy(dtype=float) - d, d - self.annuli["hi"].to_numpy(dtype=float))
        return np.maximum(gap - _SLACK * (1 + d) - 1e-6, 0)

    def highest_possible(self, m: np.ndarray) -> np.ndarray:
        """The same as an inner product: 2 q.v = |q|^2 + M - distance^2."""
        near = self.nearest_possible(m)
        return (_squares(m)[:, None] + self.most - near * near) / 2 * (1 + _SLACK) + 1


def _spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from one another: each next one is the sample's farthest from those before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def build_index(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE) -> tuple[DataFrame, Geometry]:
    """All ``_row``, ``_id``, ``_v`` with pivot ``_p``, ring ``_r``, distance ``_d`` and block ``_b``, and the geometry."""
    squared = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, width = vectors.agg(F.max(squared), F.max(F.size("_v"))).first()
    few = vectors.orderBy(F.xxhash64("_row"), "_row").limit(sample).toPandas()
    m = _matrix(list(few["_v"]), width)
    lifted = np.concatenate([m.astype(np.float64), np.sqrt(np.maximum(most - _squares(m), 0))[:, None]], axis=1)
    points = _spread(lifted, pivots)
    geometry = Geometry(points, most, np.zeros((len(points), 0)))
    d = geometry.of_vectors(m)
    nearest, least = d.argmin(1), d.min(1)
    shares = np.linspace(0, 1, rings + 1)[1:-1]
    geometry.edges = np.array([np.quantile(least[nearest == p], shares) if (nearest == p).any() else np.zeros(rings - 1) for p in range(len(points))])
    shared = vectors.sparkSession.sparkContext.broadcast(geometry)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for frame in frames:
            distance = g.of_vectors(_matrix(list(frame["_v"]), g.width))
            p = distance.argmin(1)
            near = distance.min(1)
            frame["_p"], frame["_d"] = p, near
            frame["_r"] = (near[:, None] > g.edges[p]).sum(1)
            yield frame

    index = durable(vectors.mapInPandas(keyed, "_row long, _id long, _v array<long>, _p int, _d double, _r int"))
    geometry.annuli = (index.groupBy("_p", "_r").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi"))
                       .orderBy("_p", "_r").toPandas())
    return index, geometry


def _visits(queries: DataFrame, geometry: Geometry, k: int, first: bool) -> DataFrame:
    """(``_q``, ``_v``, ``_p``, ``_r``): the annuli a query visits.

    First those nearest by bound that together have k vectors besides the query; then all others that could hold a score
    as high as ``_floor``, the k-th best found so far.
    """
    shared = queries.sparkSession.sparkContext.broadcast(geometry)

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        sizes = g.annuli["n"].to_numpy(dtype=np.int64)
        p, r = g.annuli["_p"].to_numpy(dtype=int), g.annuli["_r"].to_numpy(dtype=int)
        for frame in frames:
            m = _matrix(list(frame["_v"]), g.width)
            near = g.nearest_possible(m)
            order = np.argsort(near, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            opened = np.zeros_like(near, bool)
            np.put_along_axis(opened, order, before < k + 1, axis=1)
            if not first:
                floor = frame["_floor"].to_numpy(dtype=float)
                opened = ~opened & (np.isnan(floor)[:, None] | (g.highest_possible(m) >= floor[:, None]))
            rows, at = np.nonzero(opened)
            if len(rows):
                yield pd.DataFrame({"_q": frame["_q"].to_numpy()[rows], "_qv": [frame["_v"].iloc[i] for i in rows], "_p": p[at], "_r": r[at],
                                    "_floor": frame["_floor"].to_numpy(dtype=float)[rows]})

    return queries.mapInPandas(plan, "_q long, _qv array<long>, _p int, _r int, _floor double")


def _scored(visits: DataFrame, index: DataFrame, geometry: Geometry, k: int, block: int, query_block: int) -> DataFrame:
    """The k best of each query from each block that it visits.

    Annuli and the queries that visit them are dealt into blocks by hash, so that a task holds one block of either
    however full an annulus is; blocks of both sides meet as groups of two.
    """
    sizes = index.sparkSession.createDataFrame(
        [(int(p), int(r), -(-int(n) // block)) for p, r, n in geometry.annuli[["_p", "_r", "n"]].itertuples(index=False)],
        "_p int, _r int, _blocks int")
    asked = durable(visits)
    queues = asked.groupBy("_p", "_r").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("_queues"))
    # at most pivots x rings rows
    plan = F.broadcast(sizes.join(queues, ["_p", "_r"]))
    left = (asked.join(plan, ["_p", "_r"])
            .withColumn("_qb", F.pmod(F.xxhash64("_q"), "_queues").cast("int"))
            .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    right = (index.join(plan, ["_p", "_r"])
             .withColumn("_b", F.pmod(F.xxhash64("_row", F.lit("block")), "_blocks").cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_queues") - 1))))
    keys = ["_p", "_r", "_b", "_qb"]
    width = geometry.width

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"_q": [], "_id": [], "_score": []}).astype("int64")
        s = products(_matrix(list(q["_qv"]), width), _matrix(list(v["_v"]), width))
        ids = v["_id"].to_numpy()
        own = q["_q"].to_numpy()[:, None] == v["_row"].to_numpy()[None, :]
        out = []
        for i, name in enumerate(q["_q"].to_numpy()):
            row, free = s[i], ~own[i]
            floor = q["_floor"].iloc[i]
            if not np.isnan(floor):
                free &= row >= floor - 1e-12 * abs(floor)  # a double rounds large scores
            at = np.flatnonzero(free)
            if len(at) > k:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least]
                at = at[np.lexsort((ids[at], -row[at]))[:k]]
            out.append(pd.DataFrame({"_q": name, "_id": ids[at], "_score": row[at]}))
        return pd.concat(out)

    return left.select(*keys, "_q", "_qv", "_floor").groupBy(*keys).cogroup(right.select(*keys, "_row", "_id", "_v").groupBy(*keys)).applyInPandas(
        score, "_q long, _id long, _score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: sorted lists of at most k are merged, map-side first."""
    pair = F.struct((-F.col("_score")).alias("s"), F.col("_id").alias("i"))
    return found.groupBy("_q").agg(F.slice(F.sort_array(F.collect_list(pair)), 1, k).alias("_best"))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256,
          pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k highest inner products of each query, ties to smaller ids.

    ``is_query`` is a condition on ``id_col``. Queries meet all rows but their own; rows are told apart by position, so that
    rows of one id are queries and candidates each for itself, with an id and score of their own in the result. Rows without
    an id, and vectors that are null or hold a null or non-finite component, take no part. Vectors of different length are
    compared as if the shorter had zeros; empty ones score 0. A component or score that no long holds fails the query rather
    than wrap. Fewer rows than k give all there are.

    Two rounds: the annuli nearest to a query give a floor for its k-th score; then all annuli that could reach it are
    searched. No other one can hold a result.
    """
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.monotonically_increasing_id().alias("_row"), rows[id_col].cast("long").alias("_id"), quantized(rows[vector], scale).alias("_v"))
    vectors = durable(given.filter("_id IS NOT NULL AND _v IS NOT NULL"))
    result = "query_id long, rank int, vec_id long, score long"
    if vectors.isEmpty():
        return spark.createDataFrame([], result)
    index, geometry = build_index(vectors, pivots, rings)
    asking = vectors.withColumnRenamed("_id", id_col).filter(is_query).withColumnRenamed(id_col, "_id")
    queries = asking.select(F.col("_row").alias("_q"), "_v")
    asked = queries.withColumn("_floor", F.lit(None).cast("double"))
    seeds = durable(_top(_scored(_visits(asked, geometry, k, True), index, geometry, k, block, query_block), k))
    floor = F.when(F.size("_best") == k, -F.element_at("_best", -1)["s"]).cast("double")
    floored = queries.join(seeds.select("_q", floor.alias("_floor")), "_q", "left")
    more = _scored(_visits(floored, geometry, k, False), index, geometry, k, block, query_block)
    before = seeds.select("_q", F.explode("_best").alias("x")).select("_q", F.col("x.i").alias("_id"), (-F.col("x.s")).alias("_score"))
    best = _top(before.unionByName(more), k).select("_q", F.posexplode("_best").alias("_at", "x"))
    named = best.join(asking.select(F.col("_row").alias("_q"), F.col("_id").alias("_name")), "_q")
    return named.select(F.col("_name").alias("query_id"), (F.col("_at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
