import math
import random
import struct
import zlib

import numpy as np
import xxhash

from cohortline.llm import nbsvm
from cohortline.llm.common import table
from cohortline.llm.nbsvm import fit, features, quality_scores
from cohortline.llm.queries import op5_nbsvm
from tests.llm.fixtures import ODD_TEXTS, SMALL, documents, none


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scored = op5_nbsvm(spark, folder).join(table(spark, folder, "labels"), "doc_id").toPandas()
    apart = scored[scored.held_out]
    assert len(apart) > 50 and (apart.predicted == apart.quality).mean() > 0.95
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3) == (scored.predicted == 1)).all()


def test_odd_rows(spark):
    docs, rows = documents(spark)
    labels = spark.createDataFrame([(i, 1 if n % 3 else 0, "x") for n, (i, _, _) in enumerate(rows)] + [(1, None, "x"), (2, 7, "x")], "doc_id long, quality int, text string")
    out = quality_scores(docs, labels)
    assert out.select("row.*").columns == docs.columns
    got = out.select("row.doc_id", "row.text", "held_out", "score").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:  # the text alone decides
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_no_or_one_label(spark):
    docs, _ = documents(spark, 5)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, nothing).select("score").collect()} == {0.5}
    assert quality_scores(none(spark), nothing).count() == 0
    assert fit([features("a")], np.array([1])).score(np.zeros(1))[0] > 0.5


def test_long_text_is_read_whole():
    assert set(features("a" * (1 << 20) + " zq!#")) - set(features("a" * (1 << 20)))


# ---- a plain version: dictionaries and loops over every n-gram, dense sums -----------------------------------------


def plain_features(text):
    raw = (text or "").encode()
    found = set()
    for n in range(1, nbsvm.LONGEST + 1):
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i:i + n], "big")
            found.add(((code + n * 40503) % 2 ** 32 * 2654435761) % 2 ** 32 >> 14)
    words = [w for w in raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    again = [i for i in range(1, len(words)) if words[i] == words[i - 1]]
    marks = [True, bool(again), any(i + 1 in again for i in again), len(set(lines)) < len(lines), 2 * len(set(lines)) < len(lines), 4 * len(again) > len(words) > 0]
    return {f for f in found if f >= len(marks)} | {i for i, m in enumerate(marks) if m}


def plain_ratios(rows, labels):
    up, down = ({f: nbsvm.SMOOTHING + sum(f in r for r, y in zip(rows, labels) if y == side) for f in set().union(*rows)} for side in (1, 0))
    rest = nbsvm.DIMENSIONS - len(up)
    total = [sum(x.values()) + rest * nbsvm.SMOOTHING for x in (up, down)]
    return {f: 1.0 if f == 0 else math.log(up[f] / total[0] / (down[f] / total[1])) for f in up}, math.log(total[1] / total[0])


def plain_machine(rows, signs, ratios):
    """The same coordinate steps over dictionaries; also the duals and costs, by which optimality can be judged."""
    scaled = []
    for r in rows:
        norm = math.sqrt(sum(ratios[f] ** 2 for f in r))
        scaled.append({f: ratios[f] / norm for f in r})
    cost = [nbsvm.COST * 0.5 / (signs.count(s) / len(signs)) for s in signs]
    w, alpha, draw = {}, [0.0] * len(rows), np.random.default_rng(7)
    for _ in range(nbsvm.EPOCHS):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            x, y = scaled[i], signs[i]
            new = min(max(alpha[i] - (y * sum(v * w.get(f, 0.0) for f, v in x.items()) - 1), 0.0), cost[i])
            for f, v in x.items():
                w[f] = w.get(f, 0.0) + (new - alpha[i]) * y * v
            moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    return w, alpha, cost, scaled


def plain_model(rows, labels):
    """Weights by indicator as the dealt method has them: ratio times interpolated coefficient."""
    ratios, _ = plain_ratios(rows, labels)
    w, *_ = plain_machine(rows, [1.0 if y else -1.0 for y in labels], ratios)
    mean = sum(map(abs, w.values())) / nbsvm.DIMENSIONS
    q = nbsvm.INTERPOLATION
    return {f: ((1 - q) * mean + q * w.get(f, 0.0)) * r for f, r in ratios.items()}, ratios, mean * (1 - q)


def plain_margin(found, model, other):
    weights, ratios, mean = model
    up = sum(weights.get(f, mean * other) for f in found)
    return up / math.sqrt(sum(ratios.get(f, other) ** 2 for f in found))


def test_features_equal_plain():
    for text in ODD_TEXTS + ["a a a b\nc\nc\nc", "x" * 3, "é é"]:
        assert set(features(text).tolist()) == plain_features(text), text


def test_machine_is_the_plain_one_and_near_its_optimum():
    draw = random.Random(3)
    texts = [" ".join(draw.choice("aab" if y else "abb") * draw.randint(1, 3) for _ in range(6)) for y in [0, 1, 1] * 12]
    labels = np.array([0, 1, 1] * 12)
    rows = [plain_features(t) for t in texts]
    arrays = [np.array(sorted(r), np.int32) for r in rows]
    ratios, other = plain_ratios(rows, labels.tolist())
    got = nbsvm.log_count_ratios(arrays, labels)
    assert all(abs(got[f] - r) < 1e-12 for f, r in ratios.items()) and abs(np.median(got) - other) < 1e-12
    signs = [1.0 if y else -1.0 for y in labels]
    w, alpha, cost, scaled = plain_machine(rows, signs, ratios)
    dense = nbsvm.dual_coordinate_descent(arrays, [np.array([x[f] for f in sorted(x)]) for x in scaled], np.array(signs))
    assert all(abs(dense[f] - v) < 1e-9 for f, v in w.items()) and np.count_nonzero(dense) <= len(w)
    size = sum(v * v for v in w.values()) / 2
    loss = sum(c * max(0.0, 1 - y * sum(v * w[f] for f, v in x.items())) for c, y, x in zip(cost, signs, scaled))
    assert all(-1e-12 <= a <= c + 1e-12 for a, c in zip(alpha, cost))
    assert 0 <= size + loss - (sum(alpha) - size) < 0.05 * (size + loss)


def test_query_equals_plain(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    quality = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}

    def spark_hash(i):
        h = xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        return h - 2 ** 64 if h >= 2 ** 63 else h

    taught = sorted((i for i in quality if i in texts and not held[i]), key=spark_hash)
    assert 0 < len(taught) <= nbsvm.TRAINING_ROWS
    rows, labels = [plain_features(texts[i]) for i in taught], [quality[i] for i in taught]
    rest = [n for n in range(len(rows)) if n % 5]
    first = plain_model([rows[n] for n in rest], [labels[n] for n in rest])
    _, other = plain_ratios([rows[n] for n in rest], [labels[n] for n in rest])
    judged = [n for n in range(len(rows)) if n % 5 == 0]
    scale, shift = nbsvm.platt(np.array([plain_margin(rows[n], first, other) for n in judged]), np.array([labels[n] for n in judged]))
    model, (_, other) = plain_model(rows, labels), plain_ratios(rows, labels)
    for r in op5_nbsvm(spark, SMALL).collect():
        want = 1 / (1 + math.exp(-max(-500.0, min(500.0, scale * plain_margin(plain_features(texts[r.doc_id]), model, other) + shift))))
        assert abs(r.score - want) < 1e-3 and r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.3)


def test_repeated_label_ids(spark):
    """An id with several labels teaches each of them; the order of the label rows changes nothing."""
    docs = spark.createDataFrame([(i, f"text {'good' * (i % 2)} number {i}") for i in range(30)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(30)] + [(3, 0), (3, 1), (3, 1)]
    scores = []
    for given in (labels, labels[::-1]):
        out = quality_scores(docs, spark.createDataFrame(given, "doc_id long, quality int"))
        scores.append(sorted((r.row.doc_id, r.score) for r in out.collect()))
    assert scores[0] == scores[1]
