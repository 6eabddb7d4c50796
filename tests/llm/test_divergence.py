from collections import Counter, defaultdict

import pytest

from cohortline.llm import divergence
from cohortline.llm.divergence import source_divergence
from tests.llm.fixtures import CLASHES, documents, none


def terms(text):
    found, run = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            found += [run] if run else []
            run = ""
        else:
            run += c.lower() if c.isascii() else c
    return found


def plain(rows, min_docs):
    """rows of (text, lang, source); every share of every kept term written out."""
    rows = [(terms(t), l or "", s or "") for t, l, s in rows]
    out = set()
    for lang in {l for _, l, _ in rows}:
        held = Counter(w for ws, l, _ in rows if l == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for ws, l, s in rows:
            if l == lang:
                counts[s].update(w for w in ws if held[w] >= min_docs)
        whole = sum(counts.values(), Counter())

        def p(count):
            under = sum(count.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 5) // under for w in kept}

        q, shares = p(whole), {s: p(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum(abs(shares[s][w] - shares[o][w]) for w in kept)) for o in counts if o != s]
            over = [(w, shares[s][w] - q[w]) for w in kept if counts[s][w] and shares[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, f, k) for k, (item, f) in enumerate(found, 1) if part == "pair" or k <= 50}
    return out


@pytest.fixture
def given(spark):
    docs, rows = documents(spark, 200)
    langs = [None if i % 17 == 0 else ("en", "de\x00x", "")[i % 3] for i in range(len(rows))]
    full = [(t, l, s) for (_, t, s), l in zip(rows, langs)] + [("Abİ abİ ÀB àb 日本 日本", "en", f"src{i % 3}") for i in range(6)]
    # a source without a term, a language without one, a language with a single source
    full += [("12 34", "en", "digits"), (None, "none", "a"), ("", "none", "b"), ("word word", "one", "only")]
    extra = len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *["x"] * extra) for r in full], f"text string, lang string, source string, {CLASHES}"), full


@pytest.mark.parametrize("min_docs", [1, 6])
def test_equals_dense_shares(given, min_docs):
    docs, rows = given
    got = [tuple(r) for r in source_divergence(docs, min_docs=min_docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, min_docs)


def test_many_blocks_slices_and_vectorizers(given, monkeypatch):
    docs, rows = given
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 4)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 50)
    monkeypatch.setattr(divergence, "TASK_TERMS", 100)
    monkeypatch.setattr(divergence, "TASK_CELLS", 100)
    given = docs.fillna("", ["text", "lang", "source"])
    kept = divergence.kept_terms(given, 4)
    assert kept.count() > 400 and len(divergence.source_counts(given, kept, 200)[0].inputFiles()) > 2
    assert {tuple(r) for r in source_divergence(docs, min_docs=4, vocabulary=200).collect()} == plain(rows, 4)


def test_nothing_kept_and_empty(spark, given):
    docs, rows = given
    got = {tuple(r) for r in source_divergence(docs, min_docs=10_000).collect()}
    assert got == plain(rows, 10_000) and {r[4] for r in got} == {0} and {r[2] for r in got} == {"pair"}
    assert source_divergence(none(spark).selectExpr("*", "text AS lang")).count() == 0


def test_exact_beyond_long_products(spark):
    """1e9 times a count may pass 2**63."""
    one = spark.createDataFrame([(3 * 10**10, 7 * 10**10, 1000)], "n long, total long, terms long")
    assert one.select(divergence.share(one.n, one.total, one.terms)).first()[0] == 1 + 10**9 * (3 * 10**10 + 5) // (7 * 10**10 + 5000)


def test_long_text(spark):
    docs = spark.createDataFrame([("ab " * 400_000, "en", "s"), ("ab cd", "en", "t")], "text string, lang string, source string")
    assert {tuple(r) for r in source_divergence(docs, min_docs=1).collect()} == plain([tuple(r) for r in docs.collect()], 1)
