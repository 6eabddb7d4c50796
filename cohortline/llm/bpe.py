"""Byte-level BPE: Spark splits, counts and deals the words; tasks merge each different word of an Arrow batch once."""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import pack_row, ship

#: The most frequent words of the corpus; their ids are found once and sent to the tasks.
FREQUENT_WORDS = 1 << 18
#: Words of more bytes are merged by a heap, as each of a short word's steps looks at all pairs.
LONG_BYTES = 128
#: Words whose ids a task lays out in one step, as Python objects or positions; the rest waits in Arrow's form.
WORDS_AT_ONCE = 1 << 14
#: Above any rank.
NO_RANK = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def spark_pattern(pattern: str) -> str:
    """A splitting pattern with Unicode white space, as Java writes it."""
    return pattern.replace("\\s", "\\p{IsWhite_Space}").replace("\\S", "\\P{IsWhite_Space}")


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Vocabulary:
    """Ranks, the pattern that splits texts into words, and the tokens by rank as a literal of hexadecimal strings."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"ranks lack the single bytes {missing}")
        # the text of a plan would repeat the literal below
        spark.conf.set("spark.sql.maxPlanStringLength", 1 << 20)
        self.spark, self.raw, self.pattern = spark, ranks, spark_pattern(pattern)
        names = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            names[rank] = token.hex().upper()
        self.tokens = F.split(F.lit(",".join(names)), ",")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)

    def decoded(self, ids: Column) -> Column:
        """The bytes of the ids' tokens, one after another."""
        return _let(self.tokens, lambda tokens: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), "")))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: a token as a whole, or its bytes, of which the leftmost pair of least rank is joined until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_BYTES:
        return merge_long(word, ranks)
    pieces = [word[i:i + 1] for i in range(len(word))]
    ranked = [ranks.get(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]
    while ranked and (least := min(ranked)) < NO_RANK:
        k = ranked.index(least)
        joined = pieces[k] + pieces[k + 1]
        # pair k becomes one piece; only the ranks of the pairs beside it change
        pieces[k:k + 2] = [joined]
        del ranked[k]
        if k < len(ranked):
            ranked[k] = ranks.get(joined + pieces[k + 1], NO_RANK)
        if k:
            ranked[k - 1] = ranks.get(pieces[k - 1] + joined, NO_RANK)
    return [ranks[x] for x in pieces]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one word by a heap of pairs over a linked list; time grows with n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    start, end, prev, nxt = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if nxt[i] < n and (rank := ranks.get(word[start[i]:end[nxt[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[nxt[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, until = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != until:
            continue
        gone = nxt[i]
        alive[gone] = False
        end[i], nxt[i] = end[gone], nxt[gone]
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [ranks[word[start[i]:end[i]]] for i in range(n) if alive[i]]


def _packed(words: pa.Array, ranks: dict[bytes, int], known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and where each word's begin and the last one's end; ``known`` holds ids as packed int32."""
    packed, ends = bytearray(), np.zeros(len(words) + 1, np.int64)
    for first in range(0, len(words), WORDS_AT_ONCE):
        for i, word in enumerate(words.slice(first, WORDS_AT_ONCE).to_pylist(), first + 1):
            found = known.get(word)
            packed += np.array(merge(word.encode("utf-8"), ranks), np.int32).tobytes() if found is None else found
            ends[i] = len(packed) // 4
    return np.frombuffer(packed, np.int32), ends


def merge_words(words: pa.Array, ranks: dict[bytes, int], known: dict[str, bytes]) -> pa.Array:
    """The ids of each word, one list a word; words that ``known`` lacks are merged."""
    ids, ends = _packed(words, ranks, known)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def merge_texts(texts: pa.Array, ranks: dict[bytes, int], known: dict[str, bytes]) -> pa.Array:
    """The ids of each list of words; a word that comes again in the batch is looked up, not merged again."""
    coded = texts.flatten().dictionary_encode()
    by_word, ends = _packed(coded.dictionary, ranks, known)
    indices, sizes = coded.indices.to_numpy(), np.diff(ends)
    # some words at a time, as the positions take several times the room of the ids
    parts, counts = [np.zeros(0, np.int32)], np.zeros(len(indices) + 1, np.int64)
    for first in range(0, len(indices), WORDS_AT_ONCE):
        at = indices[first:first + WORDS_AT_ONCE]
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[at])])
        parts.append(by_word[np.arange(after[-1]) + np.repeat(ends[at] - after[:-1], sizes[at])])
        counts[first + 1:first + 1 + len(at)] = counts[first] + after[1:]
    offsets = texts.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(counts[offsets - offsets[0]], pa.int32()), pa.array(np.concatenate(parts)))


def _in_tasks(spark: SparkSession, step, ranks: dict[bytes, int], known: dict[str, bytes]):
    """``step`` over Arrow arrays as a column function; the two tables reach each Python worker once."""
    shared = spark.sparkContext.broadcast((ranks, known))

    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        return step(values, *shared.value)

    return run


def frequent(docs: DataFrame, text: str, vocabulary: Vocabulary, count: int = FREQUENT_WORDS) -> dict[str, bytes]:
    """Ids, packed as int32, of the ``count`` most frequent words that come twice or more, over all documents (ties: by the word)."""
    words = docs.select(F.explode(vocabulary.words(docs[text])).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    short = words.filter((F.octet_length("_w") <= LONG_BYTES) & (F.col("_n") > 1)).orderBy(F.desc("_n"), "_w").limit(count)
    # the limit leaves one partition
    dealt = short.repartition(docs.sparkSession.sparkContext.defaultParallelism, "_w")
    ids = _in_tasks(docs.sparkSession, merge_words, vocabulary.raw, {})
    found = dealt.select("_w", ids(F.col("_w")).alias("ids")).toArrow()
    return {w: np.array(x, np.int32).tobytes() for w, x in zip(found["_w"].to_pylist(), found["ids"].to_pylist())}


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """``row``, all columns of every row, and ``ids``, the ids of its whole text; a null text counts as empty.

    Matches of the pattern are merged separately. The most frequent words, a fixed number, are merged once and looked up; other
    words are merged once for each Arrow batch that has them, those of over LONG_BYTES bytes by a heap, in the same order of
    merges. No text is shuffled, and nothing that grows with the corpus is collected.
    """
    ship(docs.sparkSession)
    known = frequent(docs, text, vocabulary, frequent_words)
    ids = _in_tasks(docs.sparkSession, merge_texts, vocabulary.raw, known)
    split = pack_row(docs, words=vocabulary.words(docs[text]))
    return split.select(F.col("_row").alias("row"), ids(F.col("_words")).alias("ids"))
