"""Packing: pieces of tokenized documents into fixed sequences, first-fit decreasing in randomised groups."""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import durable, ship

SEQUENCE = 1024
#: Pieces of a group that one task packs; what a task holds doesn't grow with the input.
GROUP_PIECES = 50_000
#: Different words whose ids a Python worker keeps at once.
CACHED_WORDS = 300_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SPACE_BEFORE_SPACE = re.compile(r"\s ")
_AFTER_SOLID = re.compile(r"(?<=\S)(?= )")
_LONG_WORD = 64

_tokenizers: dict = {}


def _units(text: str) -> list[str]:
    """The text cut before every space that follows a solid character.

    Byte-level pieces never cross such a place: a piece has a space only at its start or in a run of white space.
    """
    if _SPACE_BEFORE_SPACE.search(text) or text.startswith(" "):
        return _AFTER_SOLID.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    ``ranks`` is a rank file's content: the vocabulary of the tokenizer's definition, whose ids are its merge ranks. The ids
    of the first words met are kept, which are the frequent ones; others are merged each time. ``added`` has the strings that
    the tokenizer takes for one token wherever they stand in a text, with their ids: the text is cut there first.
    """

    def __init__(self, ranks: bytes, pattern: str, added: dict[str, int]):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.added = {token: np.array([number], "<u4").tobytes() for token, number in added.items() if token}
        longest = sorted(self.added, key=len, reverse=True)
        self.apart = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def _learn(self, word: str) -> bytes:
        ids = array("I", self.encode(word))
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(self.known) < CACHED_WORDS and len(word) <= _LONG_WORD:
            self.known[word] = out
        return out

    def _plain(self, text: str) -> bytes:
        get, learn = self.known.get, self._learn
        return b"".join([get(u) or learn(u) for u in _units(text)])

    def __call__(self, text: str) -> bytes:
        if self.apart is None or not any(token in text for token in self.added):
            return self._plain(text)
        return b"".join([self.added.get(part) or self._plain(part) for part in self.apart.split(text) if part])


def added_tokens(definition: str) -> dict[str, int]:
    """The added tokens of a tokenizer's definition, the content of its JSON file."""
    return {t["content"]: int(t["id"]) for t in json.loads(definition).get("added_tokens", [])}


def encoder(ranks: bytes, pattern: str, added: dict[str, int]) -> Encoder:
    """One per Python worker and vocabulary."""
    key = (hash(ranks), pattern, *sorted(added.items()))
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Encoder(ranks, pattern, added)
    return _tokenizers[key]


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length): whole sequences, then half a one if the rest allows, then what is left, under half.

    For items of up to half a bin, the waste of first-fit decreasing doesn't grow with their number, and a half-full
    sequence is at a power of two.
    """
    out, at = [], 0
    while n - at >= size:
        out.append((at, size))
        at += size
    if n - at >= size // 2:
        out.append((at, size // 2))
        at += size // 2
    if n > at:
        out.append((at, n - at))
    return out


def first_fit_decreasing(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(bin, offset) of each item: longest first, into the first bin with room, found down a tournament tree.

    A leaf is a bin's free room, an inner node the larger room of its two; there are as many leaves as could be needed.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [size] * (2 * leaves)
    places = [(0, 0)] * len(lengths)
    for i in order:
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        places[i] = (node - leaves, size - room[node])
        room[node] -= need
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return places


def pieces(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0,
           size: int = SEQUENCE, added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of every row, and ``_salt``, random but the same for all pieces of a row."""
    session = docs.sparkSession
    ship(session)
    shared = session.sparkContext.broadcast((ranks, pattern, added or {}))
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(*shared.value)
        for frame in frames:
            rows = []
            for doc, t, salt in zip(frame["doc_id"], frame["_text"], frame["_salt"]):
                ids = memoryview(encode(t or "") + end)
                n = len(ids) // 4
                doc = None if pd.isna(doc) else int(doc)
                rows += [(doc, s, k, zlib.crc32(ids[4 * s:4 * (s + k)]), n, salt) for s, k in cuts(n, size)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_salt"])
            yield out.astype({"doc_id": "Int64"})

    # the position in the scan, mixed: rows of one id or text are spread over the groups like any others
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("_text"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    return rows.mapInPandas(cut, PIECES + ", _salt long")


def pack(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0,
         size: int = SEQUENCE, group_pieces: int = GROUP_PIECES, added: dict[str, int] | None = None) -> DataFrame:
    """Every piece of every row with its place: ``sequence_id`` and ``offset``.

    Null and empty texts consist of the end id alone. Strings of ``added`` in a text become their own id. Rows are told apart by position, so repeated rows and null ids are
    packed like others. Pieces are written once; each group is then packed by a task of its own, so that a lost executor
    repeats its groups only. Sequence ids have the group in the upper and a running number in the lower 32 bits.
    """
    cut = durable(pieces(docs, ranks, pattern, id_col, text, end_id, size, added))
    groups = -(-cut.count() // group_pieces) or 1

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        placed = first_fit_decreasing(frame["length"].tolist(), size)
        base = int(key[0]) << 32
        frame["sequence_id"] = [base + b for b, _ in placed]
        frame["offset"] = [o for _, o in placed]
        return frame.drop(columns=["_salt", "_group"]).astype({"doc_id": "Int64"})

    grouped = cut.withColumn("_group", F.pmod("_salt", F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(place, PIECES + ", sequence_id long, offset long")
