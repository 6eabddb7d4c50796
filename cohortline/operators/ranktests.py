"""Rank test across groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.tails import chi_square_tail
from cohortline.operators.ordered import running_totals
from cohortline.operators.survival import level_values


def kruskal_wallis(
    df: DataFrame, value: str, group: str, n_groups: int | None = None
) -> DataFrame:
    """Kruskal-Wallis test: one row with ``n``, ``h`` (tie-corrected), ``df`` and ``p``.

    Rows are compressed to counts per distinct value and group; mid-ranks come from running totals
    over the values. ``n_groups`` spares the job that counts the groups.
    """
    complete = df.dropna(subset=[value, group])
    k = n_groups if n_groups is not None else len(level_values(complete, group))
    if k < 2:
        raise ValueError("at least two groups are needed")
    counts = complete.groupBy(F.col(value).alias("value"), F.col(group).alias("grp")).agg(
        F.count("*").alias("n")
    )
    ties = counts.groupBy("value").agg(F.sum("n").alias("t"))
    ranked = running_totals(ties, "value", ["t"]).select(
        F.col("value").alias("__value"),
        F.col("t").cast("double").alias("t"),
        (F.col("cum_t") - (F.col("t") - 1) / 2.0).alias("mid_rank"),
        F.col("total_t").cast("double").alias("total"),
    )
    per_group = (
        counts.join(ranked, F.col("value").eqNullSafe(F.col("__value")))
        .groupBy("grp")
        .agg(
            F.sum("n").cast("double").alias("size"),
            F.sum(F.col("n") * F.col("mid_rank")).alias("rank_sum"),
            # every tied value is spread over its groups in proportion, so the terms add up once
            F.sum(F.col("n") * (F.col("t") * F.col("t") - 1)).alias("tied"),
            F.max("total").alias("total"),
        )
    )
    n = F.max("total")
    spread = 12.0 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size"))
    tie_factor = 1.0 - F.sum("tied") / (n * n * n - n)
    return per_group.agg(
        n.cast("bigint").alias("n"),
        F.try_divide(spread - 3.0 * (n + 1), tie_factor).alias("h"),
    ).select("n", "h", F.lit(k - 1).alias("df"), chi_square_tail("h", k - 1).alias("p"))
