"""Filter interaction audit: what each filter removes in every order, read off the lattice of filter subsets.

A state is the set of filters that have run; an edge adds one. What an edge removes depends on its state alone, not on the
order in which the state was reached, so that n filters need n * 2**(n-1) sums per part instead of n! * n. Orders that reach
a state (forward) times orders that leave it (backward) say how many orders use an edge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import durable, ship

#: n! * n rows per part are the result; more filters raise.
MOST_FILTERS = 7
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = b"#$%&*|"

_UPPER = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Edge:
    """The filter of this number, run where the filters of ``state`` (a bit each) have run, and the orders in which that happens."""

    state: int
    number: int
    orders: tuple[str, ...]
    weight: int


def lattice(names: Sequence[str]) -> list[Edge]:
    """All edges of the subset lattice; ``weight`` is the product of the path counts before and after the edge."""
    n = len(names)
    if n > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    whole = (1 << n) - 1
    reaching, ahead = {0: 1}, {0: [""]}
    for state in range(1, whole + 1):  # subsets of a state are smaller numbers
        last = [f for f in range(n) if state >> f & 1]
        reaching[state] = sum(reaching[state ^ 1 << f] for f in last)
        ahead[state] = [path + names[f] for f in last for path in ahead[state ^ 1 << f]]
    leaving, behind = {whole: 1}, {whole: [""]}
    for state in range(whole - 1, -1, -1):
        following = [f for f in range(n) if not state >> f & 1]
        leaving[state] = sum(leaving[state | 1 << f] for f in following)
        behind[state] = [names[f] + path for f in following for path in behind[state | 1 << f]]
    return [
        Edge(state, f, tuple(a + names[f] + b for a in ahead[state] for b in behind[state | 1 << f]), reaching[state] * leaving[state | 1 << f])
        for state in range(whole) for f in range(n) if not state >> f & 1
    ]


def interaction_audit(rows: DataFrame, part: Column, failing: Mapping[str, Column], losses: Mapping[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step.

    ``failing`` names each filter by one character and gives the condition under which it removes a row, ``losses`` conditions
    whose removed rows are counted; null conditions don't hold. Columns ``part``, ``filter_order``, ``step`` (from 1), ``kept``
    after and ``removed`` in the step, ``redundant`` (failing the step's filter, removed before), ``unique_fails`` (failing it
    alone), one per loss, ``shapley`` (removed by the step's filter, summed over all orders). Rows are shuffled as counts per
    part and set of failed filters. Without rows there are no parts; a null part is a part.
    """
    names = list(failing)
    edges = lattice(names)
    held = [F.coalesce(c, F.lit(False)) for c in failing.values()]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << f).otherwise(0) for f, c in enumerate(held)])
    facts = rows.select(part.alias("part"), mask.alias("mask"), *[F.coalesce(c, F.lit(False)).alias(f"lost_{x}") for x, c in losses.items()])
    counts = facts.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"lost_{x}").alias(f"lost_{x}") for x in losses])

    all_edges = F.array(*[F.struct(F.lit(e.state).alias("state"), F.lit(e.number).alias("number"), F.lit(1 << e.number).alias("bit"),
                                   F.lit(e.weight).alias("weight")) for e in edges])
    met = counts.select("*", F.inline(all_edges))
    clear = F.col("mask").bitwiseAND(F.col("state")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, column: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    sums = met.groupBy("part", "state", "number", "weight").agg(
        total(clear & ~fails, "n").alias("kept"),
        total(clear & fails, "n").alias("removed"),
        total(~clear & fails, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        *[total(clear & fails, f"lost_{x}").alias(x) for x in losses])
    shares = sums.groupBy("part", "number").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    mine = shares.select(F.col("part").alias("_part"), F.col("number").alias("_number"), "shapley")
    weighed = sums.join(mine, F.col("part").eqNullSafe(F.col("_part")) & (F.col("number") == F.col("_number")))
    paths = rows.sparkSession.createDataFrame([(e.state, e.number, list(e.orders)) for e in edges], "_state int, _number_of int, _orders array<string>")
    placed = weighed.join(paths, (F.col("state") == F.col("_state")) & (F.col("number") == F.col("_number_of")))
    return placed.select(
        "part", F.explode("_orders").alias("filter_order"), (F.bit_count("state") + 1).cast("int").alias("step"),
        "kept", "removed", "redundant", "unique_fails", *losses, "shapley")


def _text_facts(texts: pd.Series) -> pd.DataFrame:
    """Failed conditions of whole texts as bits, and the digest that equal texts share."""
    from hashlib import sha256

    bits, digests = [], []
    for raw in texts:
        raw = b"" if raw is None else bytes(raw)
        words = raw.split()
        size = len(raw)
        points = len(raw.translate(None, _CONTINUED))
        upper = size - len(raw.translate(None, _UPPER))
        bits.append((len(words) < MIN_WORDS)
                    | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
                    | (100 * upper > MAX_UPPER_PERCENT * points) << 2
                    | (len(raw.translate(None, SYMBOLS)) < size) << 3)
        digests.append(sha256(raw).digest())
    return pd.DataFrame({"bits": bits, "digest": digests})


def text_filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """The audit of five filters over whole texts; ``good_lost`` and ``toxic_lost`` are counted by ``labels``.

    A: few words; B: few different words; C: many capitals; D: a symbol; E: the text of a smaller key, anywhere in the table.
    Null texts are empty and so equal to empty ones; null parts are the part ''. A null key is neither smaller nor larger than
    another; rows that repeat a key don't fail E by each other. A key with several labels has what any of them says; labels
    without a key, and keys without a label, count for nothing. An empty table has no parts.
    """
    ship(docs.sparkSession)
    judge = F.pandas_udf(_text_facts, "bits int, digest binary")
    facts = docs.select(F.coalesce(docs[part], F.lit("")).alias("part"), docs[key].cast("long").alias("key"), judge(docs[text].cast("binary")).alias("f"))
    facts = durable(facts.select("part", "key", "f.bits", "f.digest"))
    # keys of first copies: looked up by digest and key together, so that a large group of copies meets in no task
    firsts = facts.groupBy("digest").agg(F.min("key").alias("_first")).select(F.col("digest").alias("_digest"), "_first")
    told = labels.filter(labels[key].isNotNull()).groupBy(labels[key].cast("long").alias("_key")).agg(
        F.bool_or(labels["quality"] == 1).alias("good"), F.bool_or(labels["toxic"] == 1).alias("toxic"))
    rows = facts.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("key") == F.col("_first")), "left").join(
        told, F.col("key") == F.col("_key"), "left")
    failing = {name: F.col("bits").bitwiseAND(1 << f) != 0 for f, name in enumerate("ABCD")}
    failing["E"] = F.col("key").isNotNull() & F.col("_first").isNull()
    return interaction_audit(rows, F.col("part"), failing, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
