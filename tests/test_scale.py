"""Plans under load: hot keys are split, scans are shared, filters and columns reach the files."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import aggregates, grading, joins, keyed, ordered, recurrence, report, survival
from cohortline.operators.keys import attach


@pytest.fixture
def strict(spark):
    """No broadcasts, and thresholds so small that a third of the rows counts as hot."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(spark, tmp_path):
    """60,000 rows in many files, a third of them under one key, some under none."""
    path = str(tmp_path / "hot")
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 5000)
    spark.range(60000).repartition(12).select(
        "id", key.alias("k"), (F.col("id") % 11).alias("v"), F.rand(3).alias("x")
    ).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df):
    return executed(df).split("== Initial Plan ==")[0]


def executed(df):
    """The plan after it ran; what it was before, and its subqueries, are printed too."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    """Scans that ran, those of subqueries too: only they were made part of a stage."""
    return len(re.findall(r"\*\(\d+\) ColumnarToRow\n[^\n]*FileScan", plan))


JOINS = {
    "attach": lambda df: attach(df, df.groupBy("k").agg(F.max("x").alias("m")), "k"),
    "count": lambda df: joins.attach_group_count(df, "k"),
    "offset": lambda df: keyed.with_group_max(df, "k", "x", "m"),
    "grade": lambda df: grading.with_grade(
        df.withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v"))), "k", "v", "x"
    ),
    "annotate": lambda df: joins.annotate(df, df.select("k", "v").distinct(), "k", ["v"], rename={"v": "w"}, dedupe_by=["v"]),
    "semi": lambda df: joins.semi_join(df, df.filter("v < 9"), "k"),
    "anti": lambda df: joins.anti_join(df, df.filter("k > 4000"), "k"),
    "flag": lambda df: joins.flag_membership(df, df.filter("v = 3"), "k", "f"),
}


@pytest.mark.parametrize("name", JOINS)
def test_hot_keys_are_split(strict, hot, name):
    df = JOINS[name](hot)
    assert "SortMergeJoin(skew=true)" in final_plan(df)


def test_hot_reference_keys_are_cut(strict, hot):
    """A third of the reference rows under one key: the same rows as the plain join, and no task has that key whole."""
    left = strict.range(3000).select(F.when(F.col("id") % 100 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") * 3).alias("k"), "id")
    ref = hot.select("k", F.col("id").alias("call"))
    for null_safe in (False, True):
        want = joins.annotate(left, ref, "k", ["call"], null_safe=null_safe, fill={"call": -1})
        got = joins.annotate(left, ref, "k", ["call"], null_safe=null_safe, fill={"call": -1}, hot_rows=500)
        assert got.columns == want.columns
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    pieces = {r["__hot0"]: r["__pieces"] for r in joins.hot_keys(ref, ["k"], 500).collect()}
    assert pieces[7] == -(-hot.filter("k = 7").count() // 500) and len(pieces) <= 60000 // 500
    assert joins.hot_keys(ref, ["k"], 10**9).isEmpty()


def test_reference_without_hot_keys_is_joined_once(strict, hot):
    """The hot keys are known before the join is planned: without any, each side is shuffled once."""
    left = strict.range(3000).select((F.col("id") * 3).alias("k"), "id")
    ref = hot.select("k", F.col("id").alias("call"))
    plain, got = (joins.annotate(left, ref, "k", ["call"], hot_rows=n) for n in (None, 10**6))
    assert got.exceptAll(plain).isEmpty() and got.count() == plain.count()
    assert final_plan(got).count("Join") == final_plan(plain).count("Join") == 1


def test_first_row_sort_begins_with_the_keys_hash(spark, frame):
    plan = final_plan(keyed.first_per_key(frame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int"), "k", "v"))
    sorts = re.findall(r"Sort \[(\w+)", plan)
    assert sorts and all(x.startswith("_w") for x in sorts)


def test_hot_reference_keys_under_two_names(frame):
    df = frame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "x int, y string")
    ref = frame([(1, n) for n in range(40)] + [(3, 0), (None, 5)], "z long, n int")
    got = sorted(map(tuple, joins.annotate(df, ref, {"x": "z"}, ["n"], hot_rows=10).collect()), key=str)
    assert got == sorted([(1, y, n) for y in "ab" for n in range(40)] + [(2, "c", None), (None, "d", None)], key=str)


def test_first_row_is_limited_before_the_shuffle(spark, hot):
    plan = final_plan(keyed.first_per_key(hot, "k", "id"))
    before_shuffle = plan.split("Exchange hashpartitioning")[-1]
    assert "WindowGroupLimit" in before_shuffle


def test_no_window_runs_over_raw_rows(spark, hot):
    """Group facts come from aggregates; only the range-wise running sums use windows."""
    for build in (JOINS["grade"], JOINS["count"], lambda d: keyed.with_distinct_count(d, "k", "v", "n")):
        assert not re.search(r"^\W*Window ", final_plan(build(hot)), re.M)


def test_quantiles_scan_once(spark, hot):
    plan = executed(ordered.exact_quantiles(hot, "x", {"m": 0.5}, ["v"]))
    assert scans(plan) == 1 and "ReusedExchange" in plan


def test_profile_scans_once(spark, hot):
    plan = final_plan(grading.grade_histogram(grading.stability_profile(hot, "k", "v", "x")))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("ranges", [16, 64, 1024])
def test_running_ranges_share_out_a_hot_group(spark, hot, ranges):
    """No range of the running sums holds much more than its share of the distinct values."""
    rows = hot if ranges < 1000 else spark.range(600_000).select((F.col("id") % 3).alias("v"), F.rand(5).alias("x"))
    counts = ordered.value_counts(rows, "x", ["v"])
    cuts = counts.select(ordered._cut_points(counts, "value", ["n"], ["v"], ranges).alias("c")).first().c
    values = sorted(r[0] for r in counts.select("value").collect())
    sizes = np.diff([0, *np.searchsorted(values, cuts, side="right"), len(values)])
    assert len(sizes) == ranges and max(sizes) < 1.5 * len(values) / ranges


def test_no_task_gathers_the_whole_sample(spark):
    """Parts of the sample, and what they pass on, stay within 64 rows per range."""
    counts = ordered.value_counts(spark.range(200_000).select((F.col("id") * 7 % 100_003).alias("x")), "x")
    plan = counts.select(ordered._cut_points(counts, "value", ["n"], [], 16).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "Sort" not in plan
    assert ordered.OVERSAMPLE // ordered.SORTED_IN <= 64 and 2 * ordered.KEPT <= 64


def test_scans_of_a_curve_deal_rows_once(spark, hot):
    """Survival takes two scans, the second over the results of the first: rows are dealt by range once, for both."""
    hot = hot.withColumn("died", F.col("v") > 3)
    plan = executed(survival.km_curve(hot, "id", "died", "k"))
    assert scans(plan) == 1 and len(set(re.findall(r"ShuffleQueryStage \d+\n[^\n]*- Exchange hashpartitioning\(__place[^\n]*REPARTITION_BY_COL, \[plan_id=(\d+)", plan))) == 1


def test_funnel_scans_once(spark, hot):
    funnel = report.stage_funnel(hot, [("all", F.lit(True)), ("some", F.col("x") > 0.5)], {"keys": "k", "pairs": ["k", "v"], "rows": None})
    funnel.collect()
    plan = funnel._jdf.queryExecution().executedPlan().toString()
    assert scans(plan) == 1 and "Expand" not in plan


def test_filters_and_columns_reach_the_files(spark, hot):
    plan = final_plan(aggregates.count_by(hot.filter(F.col("x") > 0.5), "v"))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(x,0.5\)", plan)
    assert "ReadSchema: struct<v:bigint,x:double>" in plan


def test_hot_key_results_are_whole(strict, hot):
    counted = joins.attach_group_count(hot, "k")
    assert counted.count() == 60000
    assert counted.filter("k = 7").select("count").first()[0] == hot.filter("k = 7").count()
    assert counted.filter("k IS NULL").select("count").first()[0] == hot.filter("k IS NULL").count()


def test_recurrence_joins_the_rows_once(spark, hot):
    calls = hot.select(
        F.col("k").alias("mrn"), F.concat(F.lit("P"), "k").alias("patient"), F.lit("g").alias("gene"),
        F.col("v").alias("p_nom"), F.col("v").cast("string").alias("name"), "x",
    )
    plan = final_plan(recurrence.recurrent_panel(calls))
    assert len(re.findall(r"FileScan parquet [^\n]*\bx#", plan)) == 1


def test_ranges_follow_the_session(spark):
    from cohortline.operators.ordered import _ranges

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20000")
        assert _ranges(spark.range(1)) == 32768
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
