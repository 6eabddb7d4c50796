import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from cohortline.llm.components import components
from cohortline.llm.simhash import fingerprint_of, links, one_per_group, simhash_groups
from tests.llm.fixtures import documents, none


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=2):
    """fingerprint -> the fingerprints reachable from it."""
    left, out = set(prints), {}
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= bits}
            left -= near
            found |= near
            todo += near
        out |= {x: found for x in found}
    return out


def test_groups_equal_brute_force(spark):
    docs, rows = documents(spark)
    prints = [slow_print(t) for _, t, _ in rows]
    assert prints == [fingerprint_of(t) for _, t, _ in rows]
    reach = groups(prints)
    least = lambda p: min((i for (i, _, _), q in zip(rows, prints) if q in reach[p] and i is not None), default=None)
    want = Counter((i, f"{p:016x}", least(p)) for (i, _, _), p in zip(rows, prints))
    assert Counter(tuple(r) for r in simhash_groups(docs).collect()) == want
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len({min(reach[p]) for p in prints}) and {i for i, _ in got} == {least(p) for p in prints}
    assert simhash_groups(none(spark)).count() == 0 and one_per_group(none(spark)).count() == 0


def test_full_blocks_are_linked_by_points(spark):
    draw = random.Random(2)
    prints = set()
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(30):
            base ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64)) if draw.random() < 0.8 else 0b111 << draw.randrange(61)
            prints.add(base)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x), n) for n, x in enumerate(sorted(prints))], "_fp long, _node long")
    for bits in (1, 2):
        reach = groups(prints, bits)
        number = {x: n for n, x in enumerate(sorted(prints))}
        want = {number[x]: min(number[y] for y in reach[x]) for x in prints if len(reach[x]) > 1}
        for paired in (1, 5, 1000):
            got = components(links(nodes, bits, paired))
            assert {r.node: r.component for r in got.collect()} == want, (bits, paired)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (51, 50)]
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(52)} | {1000 + i: 1000 for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
