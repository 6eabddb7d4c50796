"""Equi-joins of the cohort work: annotation, membership, difference, tags.

No join carries a broadcast hint. Lists and reference tables are broadcast by Spark itself when
their size is below its threshold (AQE checks the measured size), and shuffled beyond it, where
AQE splits the partitions of hot keys.

Keys are compared null-safe throughout, and where a null must not match, null keys are removed from
the right side first. The plain comparison would let an aggregated or ranked right side keep the
partitioning it already has, and AQE splits hot keys only where both sides were shuffled for the
join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.keyed import first_per_key
from cohortline.operators.keys import as_list, attach
from cohortline.session import durable


def annotate(
    df: DataFrame,
    ref: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    cols: Sequence[str],
    fill: Mapping[str, object] | None = None,
    rename: Mapping[str, str] | None = None,
    dedupe_by: Sequence[Column | str] | None = None,
    null_safe: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Left outer join of chosen reference columns.

    ``on`` maps left to right key names (or names shared keys). Rows of ``df`` without a match stay,
    ``fill`` labels what they miss. Repeated reference keys fan out unless ``dedupe_by`` gives the
    total order whose first row wins. Null keys match nothing unless ``null_safe``.

    AQE splits a key that is hot in ``df``, but not one that is hot in ``ref``, as rows without a match have to stay. With
    ``hot_rows``, reference keys of more rows are dealt to several tasks of about so many each; their keys are counted when
    this is called, and without any the join is the plain one.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in as_list(on)}
    rename = dict(rename or {})
    if dedupe_by is not None:
        ref = first_per_key(ref, list(pairs.values()), dedupe_by)
    right = ref.select(
        *[F.col(r).alias(f"__{r}") for r in pairs.values()],
        *[F.col(c).alias(rename.get(c, c)) for c in cols],
    )
    if not null_safe:
        right = right.dropna(subset=[f"__{r}" for r in pairs.values()])
    hot = None if hot_rows is None else durable(hot_keys(right, [f"__{r}" for r in pairs.values()], hot_rows))
    if hot is None or hot.isEmpty():
        conditions = [df[left].eqNullSafe(right[f"__{r}"]) for left, r in pairs.items()]
        joined = df.join(right, reduce(and_, conditions), "left").drop(*[f"__{r}" for r in pairs.values()])
    else:
        joined = _salted_left(df, right, {left: f"__{r}" for left, r in pairs.items()}, hot)
    if fill:
        joined = joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
    return joined


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The keys of more than ``hot_rows`` rows, as ``__hot0``, ``__hot1``, …, and in how many ``__pieces`` of about so many to
    cut them. There are fewer of them than rows / hot_rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    pieces = F.ceil(F.col("__n") / hot_rows).cast("int").alias("__pieces")
    return counts.select(*[F.col(k).alias(f"__hot{i}") for i, k in enumerate(keys)], pieces)


def _salted_left(df: DataFrame, right: DataFrame, pairs: Mapping[str, str], hot: DataFrame) -> DataFrame:
    """The left outer join on ``pairs``, null-safe, with the right side's ``hot`` keys (of ``hot_keys``) cut into pieces.

    They were written before, so that Spark knows their size and both sides meet them without a shuffle.

    A left row of a hot key meets every piece. Each such row has a match in some piece, as its key is one of the right
    side's, so that its unmatched copies are no rows of the result.
    """
    kept = [c for c in right.columns if c not in pairs.values()]

    def hot_pieces(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.join(hot, reduce(and_, [rows[k].eqNullSafe(hot[f"__hot{i}"]) for i, k in enumerate(keys)]), "left")

    pieces = F.coalesce("__pieces", F.lit(1))
    dealt = hot_pieces(right, list(pairs.values())).select(
        *right.columns, F.pmod(F.xxhash64(F.monotonically_increasing_id()), pieces).cast("int").alias("__piece_of"), F.lit(True).alias("__met"))
    spread = hot_pieces(df, list(pairs)).select(*df.columns, "__pieces", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("__piece"))
    same = [spread[left].eqNullSafe(dealt[r]) for left, r in pairs.items()] + [spread["__piece"].eqNullSafe(dealt["__piece_of"])]
    met = spread.join(dealt, reduce(and_, same), "left").filter(F.col("__pieces").isNull() | F.col("__met").isNotNull())
    return met.select(*df.columns, *kept)


def _matching(
    df: DataFrame, keys_df: DataFrame, on: str | Sequence[str], null_safe: bool, how: str
) -> DataFrame:
    on = as_list(on)
    keys = keys_df.select(*[F.col(k).alias(f"__{k}") for k in on]).distinct()
    if not null_safe:
        keys = keys.dropna()
    return df.join(keys, reduce(and_, [df[k].eqNullSafe(keys[f"__{k}"]) for k in on]), how)


def semi_join(
    df: DataFrame, keys_df: DataFrame, on: str | Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Keep the rows whose key occurs in ``keys_df``; a null key does so only if ``null_safe``."""
    return _matching(df, keys_df, on, null_safe, "left_semi")


def anti_join(
    df: DataFrame, keys_df: DataFrame, on: str | Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Keep the rows whose key does not occur in ``keys_df``."""
    return _matching(df, keys_df, on, null_safe, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not rows of ``b``."""
    return a.subtract(b)


def flag_membership(
    df: DataFrame, keys_df: DataFrame, on: str | Sequence[str] | Mapping[str, str], name: str
) -> DataFrame:
    """Boolean column, never null: does the row's key occur in ``keys_df``?"""
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in as_list(on)}
    keys = keys_df.select(*pairs.values()).dropna().distinct().withColumn(name, F.lit(True))
    return annotate(df, keys, pairs, [name], fill={name: False})


def flag_membership_independent(
    df: DataFrame,
    key_sets: Mapping[str, DataFrame],
    name: str,
) -> DataFrame:
    """True where every column occurs in *its own* key set, whether or not the pair occurs together.

    For the strict test of pairs pass all columns at once to :func:`flag_membership`.
    """
    flags = []
    for i, (column, keys_df) in enumerate(key_sets.items()):
        flags.append(f"__in{i}")
        df = flag_membership(df, keys_df, column, flags[-1])
    return df.withColumn(name, reduce(and_, [F.col(f) for f in flags])).drop(*flags)


def flag_gene_lists(
    df: DataFrame,
    lists: DataFrame,
    column: str,
    list_columns: Sequence[str],
    name: str,
    how: str = "all",
) -> DataFrame:
    """Is the value in all (or any) of several independent list columns of one table?"""
    if how not in ("all", "any"):
        raise ValueError("how must be 'all' or 'any'")
    # one row per value with a flag per list, so that the rows are joined once
    entries = lists.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.col(c).alias("__value"), F.lit(c).alias("__list"))
                    for c in list_columns
                ]
            )
        ).alias("e")
    ).select("e.*").dropna(subset=["__value"])
    found = F.count_distinct("__list")
    needed = len(list_columns) if how == "all" else 1
    keys = entries.groupBy("__value").agg((found >= needed).alias(name))
    return annotate(df, keys, {column: "__value"}, [name], fill={name: False})


def attach_group_count(
    df: DataFrame, keys: str | Sequence[str], name: str = "count", at_least: int = 1
) -> DataFrame:
    """Add the size of the row's group; rows of groups smaller than ``at_least`` are dropped."""
    keys = as_list(keys)
    counts = df.groupBy(*keys).agg(F.count("*").alias(name))
    if at_least > 1:
        counts = counts.filter(F.col(name) >= at_least)
    return attach(df, counts, keys, "inner")


def accumulate_tags(
    subjects: DataFrame,
    observations: DataFrame,
    key: str,
    tags: Sequence[tuple[str, Column]],
    name: str,
    separator: str = " ",
) -> DataFrame:
    """Per subject, the labels of all predicates that hold for one of its observations, in order.

    One aggregation with a boolean per label replaces one membership test per label; a subject
    without any label gets the empty text.
    """
    flags = observations.groupBy(key).agg(
        *[
            F.coalesce(F.bool_or(predicate), F.lit(False)).alias(f"__tag{i}")
            for i, (_, predicate) in enumerate(tags)
        ]
    )
    labelled = flags.select(
        key,
        F.concat_ws(
            separator,
            *[F.when(F.col(f"__tag{i}"), F.lit(label)) for i, (label, _) in enumerate(tags)],
        ).alias(name),
    )
    return annotate(subjects, labelled, key, [name], fill={name: ""})
