import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import pii
from cohortline.llm.common import table
from cohortline.llm.pii import KINDS, Field, certain_spans, examples, find_pii, gradient, regions
from cohortline.llm.queries import op12_pii
from tests.llm.fixtures import SMALL, documents, none

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def by_pattern(text):
    """The patterns as given, with their checks written out."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            double = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1]))
            good = (True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True,
                    16 <= len(digits) <= 19 and double % 10 == 0, 8 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_certain_spans_equal_the_patterns():
    draw = random.Random(4)
    pieces = ["a@b.c", "x.y+z@h-1.co.uk", "@", "1.2.3.4", "256.1.1.1", "00255.0.0.1", "+1 (017) 555-7713", "4111 1111-1111 1111", "4111111111111111", "é", "²", "٣",
              " ", "  ", "-", ".", "+", "7", "12", "0", "\n", "a", "(", ")", "+4", "1.2.3.4.5.6.7.8.9"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        assert certain_spans(text) == by_pattern(text), text
    for _ in range(3000):
        text = "".join(draw.choice("0123456789.+@a -()") for _ in range(draw.randint(0, 60)))
        assert certain_spans(text) == by_pattern(text), text


@pytest.mark.parametrize("text", ["a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "@" * 400_000, "a@" * 200_000, "Z9" * 100_000,
                                  "1 " * 100_000 + "a"])
def test_long_texts_take_linear_time(text):
    field = Field({}, np.zeros((5, 4)))
    assert sum(len(r.tokens) for r in regions(text)) > 0 and len(certain_spans(text)) >= 0
    if len(text) < 300_000:
        pii.all_spans(text, field)


def test_regions_cover_all_triggers():
    text = "no. one 1 two\n3 4  5\tx@ é9é end @"
    assert [text[r.tokens[0][0]:r.tokens[-1][1]] for r in regions(text)] == ["1", "3 4", "5\tx@ é9é", "@"]
    assert all(a[1] == b[0] for r in regions(text) for a, b in zip(r.tokens, r.tokens[1:]))


def every_segmentation(ends, n):
    """All ways to cut the tokens into plain ones and entities, as sets of (kind, start, end)."""
    def cut(j):
        if j == 0:
            yield ()
            return
        yield from cut(j - 1)
        for i, _ in ends[j]:
            for before in cut(i):
                for y in range(4):
                    yield before + ((y, i, j),)
    return list(cut(n))


def score(field, ends, entities):
    features = {(i, j): f for j, at in enumerate(ends) for i, f in at}
    label_at = {j: y for y, _, j in entities}
    return sum(field.scores(features[i, j])[y] + field.steps[label_at.get(i, 4), y] for y, i, j in entities)


@pytest.fixture
def small():
    draw = np.random.default_rng(9)
    region = next(regions("+1 23-4.x@y"))
    ends = region.segments()
    names = sorted({f for at in ends for _, fs in at for f in fs})
    return region, ends, Field({f: draw.normal(0, 0.4, 4) for f in names}, draw.normal(0, 0.5, (5, 4)))


def test_best_is_the_best_of_all(small, monkeypatch):
    region, ends, field = small
    all_cuts = every_segmentation(ends, len(region.tokens))
    assert len(all_cuts) > 300
    for margin in (0.0, 0.7, 3.0):
        monkeypatch.setattr(pii, "MARGIN", margin)
        field.known.clear()
        best = max(score(field, ends, c) - margin * len(c) for c in all_cuts)
        found = field.best(region)
        first = {s: i for i, (s, _, _) in enumerate(region.tokens)}
        end = {e: j for j, (_, e, _) in enumerate(region.tokens, 1)}
        got = [(y, first[s], end[e]) for y, s, e in found]
        assert score(field, ends, got) - margin * len(got) == pytest.approx(best)


def test_gradient_is_that_of_the_likelihood(small):
    region, ends, field = small
    cuts = every_segmentation(ends, len(region.tokens))
    truth = cuts[len(cuts) // 2]
    weights = np.exp([score(field, ends, c) for c in cuts])
    value, slopes, steps = gradient(field, ends, set(truth))
    assert value == pytest.approx(score(field, ends, truth) - np.log(weights.sum()))
    for f, y in list(product(field.weights, range(4)))[::7]:
        field.weights[f][y] += 1e-5
        up = gradient(field, ends, set(truth))[0]
        field.weights[f][y] -= 1e-5
        assert (up - value) / 1e-5 == pytest.approx(slopes[f][y], abs=1e-3)
    field.steps[4, 2] += 1e-5
    assert (gradient(field, ends, set(truth))[0] - value) / 1e-5 == pytest.approx(steps[4, 2], abs=1e-3)


def test_doubtful_matches_teach_nothing():
    assert examples("card 4111 1111 1111 1112 here") == []
    (region, truth), = examples("card 4111111111111111 here")
    assert truth == {(2, 0, 1)}
    (region, truth), = examples("version 2.0 here")
    assert truth == set()


def test_added_spans(spark):
    """Card numbers with a wrong check digit are found, license versions and keys are not; base spans stay."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = [(1, "the number 4111111111111112 is"), (2, "Apache License, Version 2.0, section 3.1"), (3, 'token = "9233A8ECF7C5B09FE5949719B6B82BCD"'),
             (4, "mail ab.12@mail7.example.com, card 4111111111111111"), (5, "in 1999 and 2024, page 12 of 300"), (6, None)]
    planted = spark.createDataFrame(texts, "doc_id long, text string")
    field = pii.fit(docs)
    got = {r.row.doc_id: r for r in find_pii(planted, field=field).collect()}
    assert [tuple(x) for x in got[1].spans] == [("card", 11, 27)] and got[1].base == []
    assert [got[i].spans for i in (2, 3, 5, 6)] == [[]] * 4
    assert [tuple(x) for x in got[4].spans] == [("email", 5, 28), ("card", 35, 51)] == [tuple(x) for x in got[4].base]


def test_query_against_the_patterns(spark):
    out = {r.doc_id: r for r in op12_pii(spark, SMALL).collect()}
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for r in rows:
        base = by_pattern(r.text or "")
        got = out[r.doc_id]
        assert [got[f"n_{k}"] for k in KINDS] == [sum(y == i for y, _, _ in base) for i in range(4)]
        written = [f"{KINDS[y]}:{s}:{e}" for y, s, e in base]
        assert got.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = [x.split(":") for x in got.spans.split(",") if x]
        assert set(written) <= set(got.spans.split(",")) or not written
        assert spans == sorted(spans, key=lambda x: (KINDS.index(x[0]), int(x[1])))


def test_odd_rows(spark):
    docs, rows = documents(spark)
    out = find_pii(docs)
    assert out.select("row.*").columns == docs.columns and out.count() == len(rows)
    same = {}
    for r in out.select("row.text", "spans").collect():
        assert same.setdefault(r.text, r.spans) == r.spans
    assert find_pii(none(spark)).count() == 0
    plain = spark.createDataFrame([(1, "nothing here"), (2, "")], "doc_id long, text string")
    assert find_pii(plain).select(F.size("spans").alias("n")).distinct().collect()[0].n == 0
