from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from cohortline.llm.filter_audit import MOST_FILTERS, interaction_audit, lattice, text_filter_audit
from tests.llm.fixtures import documents, none

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    found, word = [], ""
    for c in text + " ":
        if c in SPACE:
            found += [word] if word else []
            word = ""
        else:
            word += c
    return found


def fails(rows):
    """Per row the letters of the conditions it fails, one row after the other."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        ws = words(t)
        out.append({
            "A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)})
    return out


def plain(rows, labels):
    """Every order run for itself."""
    failed = fails(rows)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, failed) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                shapley[x] += len(gone)
                all_failing = [r for r in mine if r[1][x]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(all_failing) - len(gone), sum(sum(r[1].values()) == 1 for r in all_failing),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_equals_running_every_order(spark):
    docs, rows = documents(spark, 200)
    # copies among parts, a null text beside an empty one, a second row of a key with another text
    more = [(20_000, rows[7][1], "src1"), (20_001, rows[7][1], "src2"), (20_002, "", ""), (20_003, None, None), (20_000, "other", "src1"), (-5, rows[9][1], "src3")]
    rows += more
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    labels = [(i, n % 2, n % 3 == 0 and 1 or 0) for n, (i, _, _) in enumerate(rows) if n % 5] + [(rows[1][0], None, 1), (None, 1, 1), (99_999, 1, 1)]
    labelled = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = text_filter_audit(docs, labelled).collect()
    want = plain(rows, [r for r in labels if r[0] is not None])
    assert len(got) == len(want)
    for r in got:
        assert list(r[3:]) == want[r.part, r.filter_order, r.step], r
    assert [f.dataType.simpleString() for f in text_filter_audit(docs, labelled).schema] == ["string", "string", "int"] + ["bigint"] * 7


def test_path_counts():
    edges = lattice("ABCDE")
    assert len(edges) == 80 and all(len(set(e.orders)) == e.weight for e in edges)
    for e in edges:
        before = bin(e.state).count("1")
        assert e.weight == factorial(before) * factorial(4 - before)
        assert all({"ABCDE".index(x) for x in o[:before]} == {i for i in range(5) if e.state >> i & 1} and o[before] == "ABCDE"[e.number] for o in e.orders)
    with pytest.raises(ValueError):
        lattice("ABCDEFGHI"[:MOST_FILTERS + 1])


def test_other_filters(spark):
    """Two filters, null conditions, a null part, clashing columns, each row in one order or the other."""
    rows = spark.createDataFrame([(None, 1, None, 5), ("p", 1, 2, 5), ("p", None, 2, 5), ("p", 0, 0, 5)], "part string, mask int, state int, n int")
    out = interaction_audit(rows, rows["part"], {"x": rows["mask"] == 1, "y": rows["state"] == 2}, {"lost": rows["n"] == 5})
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in out.collect()}
    assert got[None, "xy", 1] == (0, 1, 0, 1, 1, 2) and got[None, "yx", 1] == (1, 0, 0, 0, 0, 0)
    assert got["p", "xy", 1] == (2, 1, 0, 0, 1, 1) and got["p", "xy", 2] == (1, 1, 1, 1, 1, 3)
    assert got["p", "yx", 1] == (1, 2, 0, 1, 2, 3) and got["p", "yx", 2] == (1, 0, 1, 0, 0, 1)
    assert len(got) == 8


def test_empty_and_long(spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert text_filter_audit(none(spark), nothing).count() == 0
    long = spark.createDataFrame([(1, "a b " * 500_000 + "|", "s")], "doc_id long, text string, source string")
    got = text_filter_audit(long, nothing).filter(F.col("filter_order") == "ABCDE").orderBy("step").collect()
    assert [r.removed for r in got] == [0, 1, 0, 0, 0] and got[3].redundant == 1
