import random
from statistics import mean, median, stdev

import pytest
from pyspark.sql import functions as F

from cohortline.operators import aggregates, charts, grading, joins, keyed, ordered, recurrence, report, subjects


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- grading -------------------------------------------------------------------------------------


def test_cv_of_two_of_one_and_of_zeros(frame):
    df = frame(
        [(1, "a", 0.5), (1, "a", 0.52), (1, "b", 0.4), (1, "c", 0.0), (1, "c", 0.0)],
        "mrn int, v string, af double",
    )
    got = {r.v: r.variance for r in grading.with_cv(df, ["mrn", "v"], "af").collect()}
    assert got == {"a": pytest.approx(0.027730, abs=1e-6), "b": 1.0, "c": 1.0}


EDGES = [
    (0.02, 0.5, 1), (0.03, 0.5, 1), (0.02, 0.05, 2), (0.03, 0.05, 5), (0.04, 1.0, 2), (0.04, 0.05, 3),
    (0.08, 1.0, 3), (0.08, 0.09, 4), (0.15, 0.19, 4), (0.15, 1.0, 5), (0.02, 0.1, 5), (1.0, 1.0, 5),
]


def test_grade_edges(frame):
    df = frame([e[:2] for e in EDGES], "v double, m double")
    assert [r[0] for r in df.select(grading.grade("v", "m")).collect()] == [e[2] for e in EDGES]


def test_grade_preset_a(frame):
    df = frame([(0.02, 0.11), (0.08, 0.11), (0.11, 0.5), (0.13, 0.5)], "v double, m double")
    assert [r[0] for r in df.select(grading.grade("v", "m", "A")).collect()] == [2, 4, 3, 5]


def test_missing_measure_policies(frame):
    df = frame([(1, "a", None), (1, "a", 0.4)], "mrn int, v string, af double")
    zero = grading.with_grade(df, "mrn", "v", "af", missing="zero")
    drop = grading.with_grade(df, "mrn", "v", "af", missing="drop")
    assert rows(zero, "af", "n_obs") == [(0.0, 2), (0.4, 2)]
    assert rows(drop, "af", "n_obs") == [(0.4, 1)]


def test_cv_does_not_depend_on_scale_or_row_order(frame):
    rng = random.Random(1)
    data = [(i % 5, f"v{i % 3}", rng.uniform(0.1, 0.9)) for i in range(120)]
    scaled = [(m, v, af * 7) for m, v, af in data]
    rng.shuffle(scaled)
    schema = "mrn int, v string, af double"
    one, two = (
        {
            (r.mrn, r.v): (round(r.variance, 9), r.grade)
            for r in grading.stability_profile(frame(d, schema), "mrn", "v", "af").collect()
        }
        for d in (data, scaled)
    )
    assert one == two


def test_first_date_counts_rows_without_a_measure(frame):
    df = frame(
        [(1, "a", None, "2020-01-01"), (1, "b", 0.4, "2020-02-01"), (1, "b", 0.41, "2020-03-01")],
        "mrn int, v string, af double, d string",
    ).withColumn("d", F.to_date("d"))
    profile = grading.stability_profile(df, "mrn", "v", "af", date="d").collect()
    assert [(r.v, str(r.first_date), r.n_obs) for r in profile] == [("b", "2020-01-01", 2)]


def test_null_variant_is_a_group_of_its_own(frame):
    df = frame([(1, None, 0.5), (1, None, 0.52)], "mrn int, v string, af double")
    assert rows(grading.with_grade(df, "mrn", "v", "af"), "n_obs") == [(2,), (2,)]


# --- keyed ---------------------------------------------------------------------------------------


def test_time_offset(frame):
    df = frame([("2020-01-01",), ("2020-01-31",), ("2021-02-04",), (None,)], "d string").selectExpr(
        "1 AS k", "date(d) d"
    )
    assert rows(keyed.with_time_offset(df, "k", "d"), "time_point") == [(0,), (30,), (400,), (None,)]


def test_first_per_key_ignores_input_order(frame):
    data = [(k, o, f"{k}{o}") for k in "ab" for o in range(5)]
    random.Random(3).shuffle(data)
    df = frame(data, "k string, o int, v string")
    assert rows(keyed.first_per_key(df, "k", "o"), "v") == [("a0",), ("b0",)]


def test_earliest_keeps_ties(frame):
    df = frame([(1, 5), (1, 5), (1, 6), (2, 9)], "k int, d int")
    assert rows(keyed.keep_earliest(df, "k", "d"), "k", "d") == [(1, 5), (1, 5), (2, 9)]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_group_id_is_dense_and_sorted(frame, kind):
    keys = [f"k{i:03d}" if kind == "string" else i for i in range(300)]
    data = [(k,) for k in keys for _ in range(2)] + [(None,)]
    random.Random(5).shuffle(data)
    got = {r.k: r.id for r in keyed.with_group_id(frame(data, f"k {kind}"), "k").collect()}
    assert got == {**{k: i + 1 for i, k in enumerate(keys)}, None: 301}


def test_distinct_count_counts_missing_once(frame):
    df = frame([("a",), ("a",), (None,)], "v string").withColumn("k", F.lit(1))
    assert rows(keyed.with_distinct_count(df, "k", "v", "n"), "n") == [(2,)] * 3
    assert rows(aggregates.n_unique(df, "v"), "n_unique") == [(2,)]
    assert rows(aggregates.n_unique(df, "v", count_null=False), "n_unique") == [(1,)]


# --- ordered -------------------------------------------------------------------------------------


def test_running_totals_equal_a_plain_loop(frame):
    rng = random.Random(11)
    # group "hot" holds most rows, in a narrow band of values
    data = {("hot", round(0.5 + i / 1e5, 6)): rng.randrange(9) for i in range(3000)}
    data |= {(g, float(i)): rng.randrange(9) for g in ("a", "b") for i in range(200)}
    df = frame([(g, x, n) for (g, x), n in data.items()], "g string, x double, n int")
    expected = {}
    for g in ("hot", "a", "b"):
        total = 0
        for x, n in sorted((x, n) for (h, x), n in data.items() if h == g):
            total += n
            expected[(g, x)] = total
    got = ordered.running_totals(df, "x", ["n"], ["g"]).collect()
    assert {(r.g, r.x): r.cum_n for r in got} == expected
    assert {r.total_n for r in got if r.g == "hot"} == {max(v for k, v in expected.items() if k[0] == "hot")}


def test_running_totals_over_nothing(frame):
    assert ordered.running_totals(frame([], "x double, n int"), "x", ["n"]).collect() == []


def test_exact_quantiles_equal_sorted_interpolation(frame):
    rng = random.Random(2)
    xs = [rng.choice([1.0, 2.0, rng.random() * 10]) for _ in range(501)]
    df = frame([(x,) for x in xs] + [(None,)], "x double")
    got = ordered.exact_quantiles(df, "x", {"q1": 0.25, "m": 0.5, "p9": 0.9}).first()
    s = sorted(xs)

    def quantile(p):
        h = (len(s) - 1) * p
        i = int(h)
        return s[i] + (h - i) * (s[min(i + 1, len(s) - 1)] - s[i])

    assert tuple(got) == pytest.approx((quantile(0.25), quantile(0.5), quantile(0.9)))


def test_describe_by(frame):
    xs = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 60.0]
    got = aggregates.describe_by(frame([("g", x) for x in xs], "g string, x double"), ["x"], "g").first()
    assert (got.n, got.mean, got.median) == (10, pytest.approx(mean(xs)), median(xs))
    assert got.sd == pytest.approx(stdev(xs))
    assert got.trimmed == pytest.approx(mean(sorted(xs)[1:-1]))
    assert got.mad == pytest.approx(1.4826 * median(abs(x - median(xs)) for x in xs))
    m, s = mean(xs), stdev(xs)
    assert got.skew == pytest.approx(mean((x - m) ** 3 for x in xs) / s**3)
    assert got.kurtosis == pytest.approx(mean((x - m) ** 4 for x in xs) / s**4 - 3)
    assert (got.range, got.se) == (59.0, pytest.approx(s / 10**0.5))


# --- joins ---------------------------------------------------------------------------------------


def test_annotate_fan_out_fill_and_dedupe(frame):
    left = frame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    ref = frame([("a", 1), ("a", 2), (None, 9)], "key string, x int")
    on = {"k": "key"}
    assert rows(joins.annotate(left, ref, on, ["x"], {"x": -1}), "i", "x") == [(1, 1), (1, 2), (2, -1), (3, -1)]
    assert rows(joins.annotate(left, ref, on, ["x"], dedupe_by=["x"]), "i", "x") == [(1, 1), (2, None), (3, None)]
    assert rows(joins.annotate(left, ref, on, ["x"], null_safe=True), "i", "x")[-1] == (3, 9)


def test_semi_and_anti_split_the_rows(frame):
    df = frame([(i % 7, i) for i in range(50)] + [(None, 99)], "k int, i int")
    keys = frame([(1,), (3,), (3,)], "k int")
    kept, rest = joins.semi_join(df, keys, "k"), joins.anti_join(df, keys, "k")
    assert rows(kept.union(rest), "i") == rows(df, "i")
    assert kept.filter("k NOT IN (1, 3)").count() == 0


def test_membership_is_never_null(frame):
    df = frame([(1,), (2,), (None,)], "k int")
    flagged = joins.flag_membership(df, frame([(1,), (None,)], "k int"), "k", "f")
    assert rows(flagged, "k", "f") == [(1, True), (2, False), (None, False)]


def test_independent_membership_is_not_pair_membership(frame):
    df = frame([("p1", "m2")], "p string, m string")
    known = frame([("p1", "m1"), ("p2", "m2")], "p string, m string")
    loose = joins.flag_membership_independent(df, {"p": known, "m": known}, "f")
    assert rows(loose, "f") == [(True,)]
    assert rows(joins.flag_membership(df, known, ["p", "m"], "f"), "f") == [(False,)]


def test_list_flags(frame):
    lists = frame([("x", "x"), ("y", None), (None, "z")], "a string, b string")
    df = frame([("x",), ("y",), ("z",), ("w",), (None,)], "g string")
    both = joins.flag_gene_lists(df, lists, "g", ["a", "b"], "f", "all")
    any_ = joins.flag_gene_lists(df, lists, "g", ["a", "b"], "f", "any")
    assert dict(rows(both, "g", "f")) == {"x": True, "y": False, "z": False, "w": False, None: False}
    assert dict(rows(any_, "g", "f")) == {"x": True, "y": True, "z": True, "w": False, None: False}


def test_group_count(frame):
    df = frame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert rows(joins.attach_group_count(df, "k", at_least=2), "k", "count") == [
        ("a", 2), ("a", 2), (None, 2), (None, 2)
    ]


def test_tags(frame):
    people = frame([(1,), (2,), (3,)], "mrn int")
    graded = frame([(1, 1), (1, 5), (2, 4)], "mrn int, grade int")
    assert rows(subjects.grade_tags(people, graded), "mrn", "in_grade") == [(1, "1 5"), (2, "4"), (3, "")]
    variants = graded.withColumns({"inheritance_blood": F.lit("AD/AR"), "significance": F.lit("VUS")})
    groups = subjects.exposure_groups(people, variants)
    assert rows(groups, "mrn", "exposure", "exposure_ad") == [
        (1, "Grade_12", "Grade_12_AD"), (2, "Grade_345", "Grade_345"), (3, "Grade_345", "Grade_345")
    ]


def test_review_levels_collapse(frame):
    people = frame([(i,) for i in range(4)], "mrn int")
    reviewed = frame([(0, "VUS"), (0, "P"), (1, "B"), (1, "VUS"), (2, "B")], "mrn int, path_level string")
    got = rows(subjects.collapse_tags(people, reviewed), "mrn", "path_review")
    assert got == [(0, "P"), (1, "VUS"), (2, "B"), (3, "")]


def test_inheritance_text(frame):
    people = frame([(1,), (2,)], "mrn int")
    variants = frame([(1, "AD/AR"), (1, "X-linked"), (1, None)], "mrn int, inheritance_blood string")
    assert rows(subjects.subject_inheritance(people, variants), "mrn", "inheritance") == [
        (1, "AD X-linked"), (2, None)
    ]


# --- aggregates, recurrence, reports -------------------------------------------------------------


def test_count_with_parent_total(frame):
    df = frame([("g1", "P"), ("g1", "P"), ("g1", "B")], "g string, l string")
    assert rows(aggregates.count_with_parent_total(df, "g", "l"), "l", "count", "freq") == [
        ("B", 1, 3), ("P", 2, 3)
    ]
    assert rows(aggregates.count_with_parent_total(df, [], "l"), "l", "count", "freq") == [
        ("B", 1, 3), ("P", 2, 3)
    ]


def test_freq_table_leaves_missing_out(frame):
    assert rows(aggregates.freq_table(frame([("a",), (None,)], "v string"), "v"), "v", "count") == [("a", 1)]


CALLS = [
    # patient, mrn, gene, p_nom, name
    ("A", 1, "g", "p1", "n1"), ("A", 1, "g", "p1", "n1"), ("A", 1, "g", "p2", "n2"),
    ("B", 2, "g", "p2", "n2"), ("B", 2, "g", "p2", "n2"), ("B", 2, "h", "p9", "n9"),
    ("C", 3, "g", "p1", "n1"), ("C", 3, "h", "p2", "n2"),
    ("D", 4, "k", "p1", "n1"), ("D", 4, "k", "p1", "n1"), (None, 4, "k", "p1", "n1"),
]


def brute_recurrent(calls, strict):
    from collections import Counter

    gene = Counter((p, m, g) for p, m, g, _, _ in calls)
    subjects_ = {m for (_, m, _), n in gene.items() if n >= 2}
    change = Counter((p, m, c) for p, m, _, c, _ in calls if m in subjects_)
    pairs = {(m, c) for (_, m, c), n in change.items() if n >= 2}
    ms, cs = {m for m, _ in pairs}, {c for _, c in pairs}
    kept = [r for r in calls if r[0] and ((r[1], r[3]) in pairs if strict else r[1] in ms and r[3] in cs)]
    count = Counter((r[0], r[4]) for r in kept)
    return sorted((*r, count[r[0], r[4]]) for r in kept if count[r[0], r[4]] >= 2)


@pytest.mark.parametrize("strict", [False, True])
def test_recurrent_panel_equals_brute_force(frame, strict):
    rng = random.Random(8)
    calls = CALLS + [
        (rng.choice("EFG"), rng.randrange(5, 8), rng.choice("xy"), rng.choice(["p1", "p3"]), rng.choice(["n1", "n3"]))
        for _ in range(60)
    ]
    df = frame(calls, "patient string, mrn int, gene string, p_nom string, name string")
    got = rows(
        recurrence.recurrent_panel(df, strict_pairs=strict),
        "patient", "mrn", "gene", "p_nom", "name", "count",
    )
    assert sorted(got) == brute_recurrent(calls, strict)


def test_recurrent_broad_scopes_after_counting_variants(frame):
    df = frame(
        [("A", "v1", True), ("A", "v1", True), ("A", "v2", False), ("B", "v1", True), ("B", "v1", True),
         ("C", "v1", True), ("C", "v1", None), ("C", "v2", True)],
        "cgl string, g_nomen string, in_blood boolean",
    )
    assert rows(recurrence.recurrent_broad(df), "cgl", "g_nomen", "count") == [("A", "v1", 2), ("A", "v1", 2)]


def test_funnel_shares(frame):
    df = frame([(1, "a"), (1, "b"), (2, None)], "m int, v string")
    funnel = report.cohort_funnel([("all", df), ("one", df.filter("m = 1"))], {"patients": "m", "variants": "v", "rows": None})
    got = {r.stage: r for r in funnel.collect()}
    assert (got["all"].patients, got["all"].variants, got["all"].rows_share) == (2, 3, 1.0)
    assert got["one"].patients_share == 0.5
    assert all(0 <= got["one"][f"{m}_share"] <= 1 for m in ("patients", "variants", "rows"))


def test_pathogenic_calls_of_any_kind(frame):
    people = frame([(1,), (2,), (3,)], "mrn int")
    candidates = frame([(1, 1, "AD", "Benign")], "mrn int, grade int, inheritance_blood string, significance string")
    calls = frame([(1, "Benign"), (2, "Pathogenic"), (2, None), (3, "Likely pathogenic"), (None, "Pathogenic")], "mrn int, significance string")
    got = {r.mrn: (r.in_pathogenic, r.carries_pathogenic) for r in subjects.exposure_groups(people, candidates, calls=calls).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (False, False)}


def test_stage_funnel_equals_that_of_frames(frame):
    df = frame([(i % 7, None if i % 5 == 0 else f"v{i % 11}", i) for i in range(60)], "m int, v string, x int")
    conditions = [("all", F.lit(True)), ("half", F.col("x") > 30), ("known", (F.col("x") > 30) & (F.col("v") != "v3")), ("none", F.col("x") < 0)]
    measures = {"patients": "m", "pairs": ["m", "v"], "variants": "v", "rows": None}
    want = report.cohort_funnel([(name, df.filter(c)) for name, c in conditions], measures)
    got = report.stage_funnel(df, conditions, measures)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert [tuple(r)[2:6] for r in report.stage_funnel(df.limit(0), conditions, measures).collect()] == [(0, 0, 0, 0)] * 4


def test_gene_classes(frame):
    lists = frame(
        [("x", "AD", "x", None), ("y", "AR", None, "y"), (None, None, "z", "w")],
        "germline_blood string, inheritance_blood string, somatic_blood string, chip string",
    )
    counts = frame([("x", 5), ("y", 2), ("z", 3), ("w", 1)], "gene string, count long")
    classes = report.classify_genes(counts, lists, either=["chip"])
    assert rows(classes, "gene", "known", "chip", "inheritance_blood") == [
        ("w", "Not Associated", True, None), ("x", "Germline Somatic", False, "AD"),
        ("y", "Germline", True, "AR"), ("z", "Somatic", False, None),
    ]
    summary = report.class_summary(
        classes, F.col("known").contains("Germline"), lists, ["germline_blood"], counts
    ).first()
    assert (summary.class_variants, summary.all_variants, summary.class_genes) == (7, 11, 2)
    assert (summary.gene_share, summary.expected_share) == (0.5, 0.5)


def test_box_summary_and_outliers(frame):
    df = frame([("g", float(x)) for x in (1, 2, 3, 4, 100)], "g string, x double")
    box = charts.box_summary(df, "x", "g")
    r = box.first()
    assert (r.min, r.q1, r.median, r.q3, r.max) == (1, 2, 3, 4, 100)
    assert (r.lower_whisker, r.upper_whisker, r.n_outliers) == (1, 4, 1)
    assert rows(charts.outliers(df, box, "x", "g"), "x") == [(100.0,)]


def test_trajectory_drops_values_outside_the_axis(frame):
    df = frame([(60, 0.5, "G"), (0, 1.2, "G")], "days int, af double, g string")
    assert rows(charts.trajectory(df, "days", "af", ["g"]), "series", "months", "af") == [("G", 2.0, 0.5)]
