from collections import Counter

import pytest

from cohortline.llm.line_dedup import line_dedup
from cohortline.llm.line_quality import base_counts, line_quality, repeated_words, without_frequent_lines
from tests.llm.fixtures import documents, none

SPACE = " \t\n\x0b\x0c\r"


def share_of(rows, key):
    pages, having = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        having.update({(s, k) for k in map(key, (t or "").split("\n")) if k})
    return lambda s, k, ratio, least: having[s, k] >= least and having[s, k] > ratio * pages[s]


def test_line_dedup_equals_plain(spark):
    docs, rows = documents(spark)
    bad = share_of(rows, lambda x: x.strip(SPACE))
    want = Counter()
    for i, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not bad(s, x.strip(SPACE), 0.15, 2)]
        want[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    out = line_dedup(docs, max_ratio=0.15, min_pages=2)
    assert out.select("row.*").columns == docs.columns
    assert Counter(tuple(r) for r in out.select("row.doc_id", "row.text", "n_lines", "n_dropped").collect()) == want
    assert sum(n * k[3] for k, n in want.items()) > 0
    assert line_dedup(none(spark)).count() == 0


def fold(line):
    return " ".join(line.encode().lower().decode().translate(str.maketrans(SPACE, " " * 6)).split(" ")).split()


def test_line_quality_equals_plain(spark):
    docs, rows = documents(spark)
    key = lambda x: " ".join(fold(x))
    once = {(i, n if i is None else 0, t, s): (i, t, s) for n, (i, t, s) in enumerate(rows)}  # a row without an id is its own
    bad = share_of(list(once.values()), key)
    want, texts = Counter(), Counter()
    for i, t, s in rows:
        lines = (t or "").split("\n")
        words = [w for x in lines for w in x.translate(str.maketrans(SPACE, " " * 6)).split(" ") if w]
        solid = [x for x in lines if x.strip(SPACE)]
        windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        repeat = {k + o for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for o in range(8)}
        left = len(words) - sum(len(fold(x)) for x in lines if key(x) and bad(s, key(x), 0.15, 2))
        failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
        want[i, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(solid) - len(set(solid)), len(repeat),
             failed, left, not failed and 2 * left >= len(words)] += 1
        texts[i, None if t is None else "\n".join(x for x in lines if not (key(x) and bad(s, key(x), 0.15, 2)))] += 1
    got = line_quality(docs, max_share=0.15, min_docs=2)
    assert Counter(tuple(r) for r in got.collect()) == want
    cleaned = without_frequent_lines(docs, max_share=0.15, min_docs=2)
    assert cleaned.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in cleaned.collect()) == texts
    assert line_quality(none(spark)).count() == 0


def test_repeated_rows_are_one_document(spark):
    """One document given 25 times beside 148 others makes no line frequent; 25 documents of the same lines do."""
    words = " ".join(f"w{i}" for i in range(30))
    others = [(i, " ".join(f"o{i}x{j}" for j in range(30)), "s") for i in range(148)]
    for ids, kept in (([1000] * 25, True), (range(1000, 1025), False), ([None] * 25, False)):
        docs = spark.createDataFrame(others + [(i, words, "s") for i in ids], "doc_id long, text string, source string")
        got = [r.kept for r in line_quality(docs).filter("doc_id IS NULL OR doc_id >= 1000").collect()]
        assert got == [kept] * 25
        cleaned = without_frequent_lines(docs).filter("doc_id IS NULL OR doc_id >= 1000").collect()
        assert {r.text for r in cleaned} == {words if kept else ""}


@pytest.mark.parametrize("words, covered", [([], 0), (["a"] * 8, 0), (["a"] * 9, 9), (list("abcdefgh") * 2, 16), (list("abcdefghx") + list("abcdefgh"), 16)])
def test_repeated_words(words, covered):
    assert repeated_words([w.encode() for w in words]) == covered


def test_very_long_text():
    assert base_counts("word " * 300_000)[0] == 300_000
