import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortline.llm.topk import top_k

KIND = "vec_id long, embedding array<float>, label int, _id long, _v string, score string"


def brute(rows, k=5):
    """Result rows, counted, as rows of one id may have equal ones."""
    ints = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints.append((i, [math.floor(256 * x) for x in v]))
    out = Counter()
    for n, (q, a) in enumerate(ints):
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ints) if m != n)
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1))
    return out


def made(seed, n, width, copies):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([draw.gauss(0, 0.2), 0.25])for _ in range(width)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies)]
    rows += [(9001, None), (9002, [None, 1.0]), (9003, [float("nan")] * width), (9004, [float("inf")]), (None, [1.0] * width), (9005, []),
             (9010, [0.5]), (7, [0.0] * width), rows[3], rows[5], (5, [1.0] * width)]
    return [(i, v, 1, None, "x", "y") for i, v in rows]


def test_equals_brute_force(spark):
    for seed, n, width, copies in ((1, 150, 6, 60), (2, 40, 1, 0)):
        rows = made(seed, n, width, copies)
        got = top_k(spark.createDataFrame(rows, KIND), F.col("vec_id") % 5 == 0, pivots=6, rings=3, block=16, query_block=8)
        assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
        assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_few_and_no_rows(spark):
    two = [(0, [1.0], 1, None, "", ""), (1, [2.0], 1, None, "", "")]
    got = top_k(spark.createDataFrame(two, KIND), F.col("vec_id") % 5 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512)]
    assert top_k(spark.createDataFrame(two[:1], KIND), F.col("vec_id") % 5 == 0).count() == 0
    assert top_k(spark.createDataFrame([], KIND), F.col("vec_id") % 5 == 0).count() == 0


def test_rows_of_one_id_stay_apart(spark):
    rows = [(0, [1.0], 1, None, "", ""), (1, [2.0], 1, None, "", ""), (1, [9.0], 1, None, "", ""), (0, [3.0], 1, None, "", "")]
    got = top_k(spark.createDataFrame(rows, KIND), F.col("vec_id") % 5 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_large_components(spark):
    """Scores beyond double precision are exact; what no long holds fails."""
    big = [(i, [float(2 ** 22 + 3 * i), float(i), 1.0], 1, None, "", "") for i in range(40)] + [(50, [-2.0 ** 22], 1, None, "", "")]
    got = top_k(spark.createDataFrame(big, KIND.replace("float", "double")), F.col("vec_id") % 5 == 0, pivots=3, rings=2)
    assert Counter(tuple(r) for r in got.collect()) == brute(big)
    for x in (1e30, 2.0 ** 40):
        rows = [(0, [x], 1, None, "", ""), (1, [x], 1, None, "", "")]
        with pytest.raises(Exception, match="too large|not fit"):
            top_k(spark.createDataFrame(rows, KIND.replace("float", "double")), F.col("vec_id") % 5 == 0).collect()
