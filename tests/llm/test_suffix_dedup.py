import random
from collections import Counter

import pytest

from cohortline.llm import suffix_dedup as S
from tests.llm.fixtures import documents, none


def brute(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + width] for r in raws for i in range(len(r) - width + 1))
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                mark[i:i + width] = b"\x01" * width
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        yield len(r), sum(mark), spans, bytes(b for b, m in zip(r, mark) if not m)


def same(df, rows, width=200):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())
    assert got == Counter((i, *x) for i, x in zip((r[0] for r in rows), brute([r[1] for r in rows], width)))


def test_documents(spark):
    docs, rows = documents(spark, 120)
    same(S.suffix_dedup(docs), rows)
    assert S.suffix_dedup(none(spark)).count() == 0


@pytest.mark.parametrize("together", [512, 1])
def test_passages_and_periods(spark, together, monkeypatch):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passages = [word(150), word(260), word(900)]
    rows = [(i, word(draw.randrange(300)) + draw.choice(passages) + word(draw.randrange(300)) + passages[i % 3][i:]) for i in range(40)]
    rows += [(100, "a" * 260), (101, "ab" * 200 + "x"), (102, "a" * 199), (103, "xyz" * 90), (104, word(50) + "xyz" * 80), (104, "a" * 200), (None, "b" * 200)]
    real = S.repeated_spans
    monkeypatch.setattr(S, "repeated_spans", lambda named, width: real(named, width, together=together))
    same(S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_segments_do_not_matter(monkeypatch):
    raw = bytes(random.Random(1).choices(range(97, 100), k=5000)) + b"a" * 700
    whole = {(int(k), int(s) + o) for st, n, ks in S.phrases(raw) for s, c, k in zip(st, n, ks) for o in range(c)}
    monkeypatch.setattr(S, "_SEGMENT", 333)
    assert whole == {(int(k), int(s) + o) for st, n, ks in S.phrases(raw) for s, c, k in zip(st, n, ks) for o in range(c)}
    assert len(whole) == len(raw) - 199
