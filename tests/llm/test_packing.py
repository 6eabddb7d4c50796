import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cohortline.llm.packing import added_tokens, cuts, first_fit_decreasing, pack
from cohortline.llm.queries import packing_ranks
from tests.llm.fixtures import documents, none


def test_every_id_once_and_places(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, rows = documents(spark)
    special = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext|", "x <|endoftext|>\n\n  y", "<|endoftext|>" * 1500]
    rows += [(30_000 + i, t, None) for i, t in enumerate(special)]
    docs = docs.unionByName(spark.createDataFrame(rows[-len(special):], "doc_id long, text string, source string"), allowMissingColumns=True)
    added = added_tokens(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    assert added == {"<|endoftext|>": 50256}
    got = pack(docs, packing_ranks(), public_tokenizers.PATTERN, group_pieces=40, added=added).collect()
    have, want = defaultdict(int), defaultdict(int)
    for r in got:
        have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for i, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for s, n in cuts(len(ids)):
            want[i, s, n, zlib.crc32(ids[s:s + n].tobytes()), len(ids)] += 1
    assert have == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert len({s >> 32 for s in places}) > 1
    padding = 0
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.1 * sum(r.length for r in got)
    assert pack(none(spark), packing_ranks(), public_tokenizers.PATTERN).count() == 0


def test_tree_equals_plain_first_fit():
    draw = np.random.default_rng(5)
    lengths = [int(x) for x in draw.integers(1, 513, 700)] + [1024, 512, 512, 1]
    room, want = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, free in enumerate(room) if free >= lengths[i]), len(room))
        if b == len(room):
            room.append(1024)
        want[i] = (b, 1024 - room[b])
        room[b] -= lengths[i]
    assert first_fit_decreasing(lengths) == want
    assert first_fit_decreasing([]) == []


def test_cuts_cover():
    for n in (1, 511, 512, 513, 1023, 1024, 1025, 5000):
        pieces = cuts(n)
        assert sum(k for _, k in pieces) == n and [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]
