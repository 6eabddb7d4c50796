"""Suffix-array dedup by prefix-free parsing: bytes of 200-byte strings that start anywhere else are removed.

A rolling hash of GRAM bytes triggers phrases: every window of WIDTH bytes belongs to the least (leftmost) hash in it, and a
phrase is a run of window starts that share their trigger. Equal windows have equal triggers at equal places, so copies can
only lie in phrases of one trigger hash. Phrases with the same text are one dictionary entry; an entry that the corpus has
twice is removed whole, and only entries that share a trigger with a different entry have the suffixes of their text
sorted, by the WIDTH bytes that matter: equal neighbours in that order are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import durable, ship

WIDTH = 200
GRAM = 32
#: Entries of one trigger whose suffixes one task sorts together; those of a fuller one are cut up first,
SORTED = 512
#: into parts of so many windows, and again where need be.
STEPS = (16, 1)
#: Window starts that are parsed at once, to bound memory on very long texts.
_SEGMENT = 1 << 20
_ROWS = 20_000
_ENTRY = ["_key", "_t", "_u", "_s", "_n", "_body", "_times"]


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _rolling(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes (a power of two), from hashes of its halves."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(0xFF51AFD7ED558CCD) + h[size:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, h
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[:len(out) - (width - size)], out[width - size:])


def phrases(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, numbers of window starts, and trigger hashes (signed) of a text's phrases, segment by segment."""
    total = len(raw) - width + 1
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, total, _SEGMENT):
        n = min(_SEGMENT, total - at)
        h = _rolling(whole[at:at + n + width - 1], gram)
        least = _sliding_least(h, width - gram + 1)
        new = np.empty(n, bool)
        new[0] = True
        # the next window has another trigger if a smaller hash comes in or the trigger was at this window's start
        new[1:] = (least[1:] != least[:-1]) | (h[:n - 1] == least[:-1])
        starts = np.flatnonzero(new)
        yield starts + at, np.diff(np.append(starts, n)), least[starts].view(np.int64)


def _identified(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Texts with a name of 128 bits, from id and text: what is found holds for the rows of a name alike."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), body.alias("_text"), F.xxhash64(body).alias("_t"),
                       F.xxhash64(docs[id_col], F.lit("id"), body).alias("_u"))


def _parse(named: DataFrame, keys_only: bool, width: int, gram: int) -> DataFrame:
    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                got = [k for x in frame["_text"].iloc[at:at + 500] for _, _, k in phrases(_encode(x), width, gram)]
                if got:
                    yield pd.DataFrame({"_key": np.concatenate(got)})

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for frame in frames:
            parts, size = [], 0
            for x, t, u in zip(frame["_text"], frame["_t"], frame["_u"]):
                raw = _encode(x)
                for starts, counts, key in phrases(raw, width, gram):
                    ends = (starts + counts + width - 1).tolist()
                    full = np.array([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends)], np.uint64).view(np.int64)
                    parts.append((np.full(len(starts), t), np.full(len(starts), u), starts, counts, key, full))
                    size += len(starts)
                if size >= _ROWS:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts)))))
                    parts, size = [], 0
            if parts:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts)))))

    names = ["_t", "_u", "_s", "_n", "_key", "_full"]
    if keys_only:
        return named.select("_text").mapInPandas(keys, "_key long")
    return named.select("_text", "_t", "_u").mapInPandas(parse, "_t long, _u long, _s int, _n int, _key long, _full long")


def _packed(text: Column) -> Column:
    """Texts as compressed bytes, for the shuffle."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=3)
        return pd.Series([press.compress(_encode(x)) for x in texts])

    return pack(text)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def equal_windows(bodies: list[bytes], counts: list[int], width: int = WIDTH) -> list[list[int]]:
    """For each entry, the offsets of its windows that equal another window of these entries.

    The suffixes of all entries are sorted by their first ``width`` bytes; equal ones are neighbours.
    """
    suffixes = sorted((body[o:o + width], i, o) for i, (body, n) in enumerate(zip(bodies, counts)) for o in range(n))
    found: list[list[int]] = [[] for _ in bodies]
    last = len(suffixes) - 1
    for at, (suffix, i, o) in enumerate(suffixes):
        if (at and suffixes[at - 1][0] == suffix) or (at < last and suffixes[at + 1][0] == suffix):
            found[i].append(o)
    return found


def _runs(offsets: list[int]) -> list[tuple[int, int]]:
    """Half-open runs of consecutive numbers."""
    out: list[list[int]] = []
    for o in sorted(offsets):
        if out and out[-1][1] == o:
            out[-1][1] = o + 1
        else:
            out.append([o, o + 1])
    return [tuple(x) for x in out]


def _edges_sorted(entries: DataFrame, width: int) -> DataFrame:
    """Spans of window starts from entries whose trigger has few: each trigger's suffixes are sorted together."""

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def settled(group: list[tuple]) -> list[tuple]:
            found = equal_windows([x[5] for x in group], [x[4] for x in group], width)
            return [(x[1], x[2], x[3] + a, x[3] + b) for x, at in zip(group, found) if x[6] == 1 for a, b in _runs(at)]

        for frame in frames:
            spans = []
            for row in zip(*[frame[c] for c in _ENTRY]):
                if held and held[0][0] != row[0]:
                    spans += settled(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(spans, columns=["_t", "_u", "_a", "_b"])
        if held:
            yield pd.DataFrame(settled(held), columns=["_t", "_u", "_a", "_b"])

    dealt = entries.repartition("_key").sortWithinPartitions("_key")
    return dealt.mapInPandas(settle, "_t long, _u long, _a int, _b int")


def _cut_at_trigger(entries: DataFrame, step: int, width: int, gram: int) -> DataFrame:
    """Entries cut into parts of at most ``step`` windows, at fixed distances from their trigger.

    All windows that could lie in a part share its core, the bytes that every one of them has; equal windows are thus in
    parts of one core, which is the parts' new key.
    """
    digest = xxhash.xxh3_64_intdigest

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, t, u, s, n, body, times in zip(*[frame[c] for c in _ENTRY]):
                x = int(_rolling(np.frombuffer(body[:width], np.uint8), gram).argmin())
                for number in range((x - n + 1) // step, x // step + 1):
                    first, last = x - (number + 1) * step + 1, x - number * step
                    a, b = max(first, 0), min(last, n - 1)
                    core = digest(b"%d %d " % (key, number) + body[last:first + width])
                    part = body[a:b + width]
                    rows.append((core - (1 << 63), digest(b"%d " % (a - first) + part) - (1 << 63), t, u, s + a, b - a + 1, part, times))
                if len(rows) > _ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["_key", "_full", *_ENTRY[1:]]
    return entries.select(*_ENTRY).mapInPandas(cut, "_key long, _full long, _t long, _u long, _s int, _n int, _body binary, _times long")


def _edges(entries: DataFrame, width: int, gram: int, together: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Spans of window starts from entries that share their trigger with other ones.

    Up to ``together`` entries of a trigger are sorted in one task. Those of a fuller one are cut into short parts, and
    these are counted: equal parts are copies; different ones of one core go the same way again, with shorter parts. At one
    window nothing is left, so a trigger that a third of all texts have costs a few rows for each of its entries.
    """
    spans = _edges_sorted(entries.filter(F.col("_entries") <= together), width)
    if not steps:
        return spans
    parts = durable(_cut_at_trigger(entries.filter(F.col("_entries") > together), steps[0], width, gram))
    counts = durable(parts.groupBy("_key", "_full").agg(F.count(F.lit(1)).alias("_c")))
    whole = parts.filter("_times = 1").join(counts.filter("_c > 1"), ["_key", "_full"]).select(
        "_t", "_u", F.col("_s").alias("_a"), (F.col("_s") + F.col("_n")).alias("_b"))
    several = counts.groupBy("_key").agg(F.count(F.lit(1)).alias("_entries")).filter("_entries > 1")
    # one of each kind of part stands for all; it asks for spans only if it is the only one
    left = (parts.join(several, "_key").join(counts, ["_key", "_full"])
            .withColumn("_times", F.greatest("_times", "_c")).dropDuplicates(["_key", "_full"]))
    return spans.unionByName(whole).unionByName(_edges(left, width, gram, together, steps[1:]))


def repeated_spans(named: DataFrame, width: int = WIDTH, gram: int = GRAM, together: int = SORTED) -> DataFrame:
    """(``_t``, ``_u``, ``_spans``): the runs [a, b) of window starts of a text that are found elsewhere too."""
    again = durable(_parse(named, True, width, gram).groupBy("_key").agg(F.count(F.lit(1)).alias("_c"))
                    .filter("_c > 1").select("_key"))
    shared = durable(_parse(named, False, width, gram).join(again, "_key"))
    entries = durable(shared.groupBy("_key", "_full").agg(
        F.count(F.lit(1)).alias("_times"), F.min(F.struct("_t", "_u", "_s", "_n")).alias("_at")))
    whole = shared.join(entries.filter("_times > 1").select("_key", "_full"), ["_key", "_full"]).select(
        "_t", "_u", F.col("_s").alias("_a"), (F.col("_s") + F.col("_n")).alias("_b"))

    # an entry may share windows with the others of its trigger only
    several = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("_entries"), F.min("_times").alias("_least")).filter("_entries > 1 AND _least = 1")
    wanted = entries.join(several, "_key").select("_key", "_times", "_entries", "_at.*").groupBy("_t", "_u").agg(
        F.collect_list(F.struct("_key", "_times", "_entries", "_s", "_n")).alias("_want"))
    texts = named.select("_t", "_u", _packed(F.col("_text")).alias("_pack"))

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t, u, packed, want in zip(frame["_t"], frame["_u"], frame["_pack"], frame["_want"]):
                raw = _unpack(packed)
                rows += [(w["_key"], t, u, w["_s"], w["_n"], raw[w["_s"]:w["_s"] + w["_n"] + width - 1], w["_times"], w["_entries"]) for w in want]
                if len(rows) > _ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["_key", "_t", "_u", "_s", "_n", "_body", "_times", "_entries"]
    kinds = "_key long, _t long, _u long, _s int, _n int, _body binary, _times long, _entries long"
    # rows of one name have one text: any of them serves, dropped before the shuffle that the join needs anyway
    bodies = durable(texts.dropDuplicates(["_t", "_u"]).join(wanted, ["_t", "_u"]).mapInPandas(fetch, kinds))
    spans = whole.unionByName(_edges(bodies, width, gram, together))
    return spans.groupBy("_t", "_u").agg(F.collect_set(F.struct("_a", "_b")).alias("_spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes.

    Texts are UTF-8 bytes, null is empty; nothing of a text under ``width`` bytes goes. Repeated rows are copies of each other, so
    from ``width`` bytes on they go whole. What is left may cut a character; it stays bytes.
    """
    ship(docs.sparkSession)
    named = _identified(docs, id_col, text)
    spans = repeated_spans(named, width)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(packs: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        rows = []
        for packed, found in zip(packs, all_spans):
            raw = _unpack(packed)
            kept, end, spans_here = [], 0, 0
            for a, b in sorted((x["_a"], x["_b"]) for x in found) if found is not None else ():
                if a > end or not spans_here:
                    kept.append(raw[end:a])
                    spans_here += 1
                end = max(end, b + width - 1)
            left = b"".join([*kept, raw[end:]])
            rows.append((len(raw), len(raw) - len(left), spans_here, left))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    texts = named.select("doc_id", "_t", "_u", _packed(F.col("_text")).alias("_pack"))
    return texts.join(spans, ["_t", "_u"], "left").select("doc_id", cut("_pack", "_spans").alias("_c")).select("doc_id", "_c.*")
