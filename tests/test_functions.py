import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortline.functions import casting, dates, predicates, significance, tails, text
from cohortline.functions.significance import normalize_significance


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_variant_name_spells_out_missing_parts(frame):
    df = frame([("NM_1:c.1A&gt;T", "G1", None)], "c_nom string, gene string, p_nom string")
    g, s = text.split_pair(text.unescape_gt("c_nom"))
    assert values(df, text.variant_name(g, "gene", s, "p_nom")) == ["NM_1(G1):c.1A>T (NA)"]


def test_split_pair_drops_and_pads(frame):
    df = frame([("a:b:c",), ("a",), (None,)], "v string")
    first, second = text.split_pair("v")
    assert values(df, first) == ["a", "a", None]
    assert values(df, second) == ["b", None, None]


def test_variant_key_has_three_blanks_and_no_null(frame):
    df = frame([("G", None)], "a string, b string")
    assert values(df, text.variant_key("a", "b")) == ["G   NA"]


def test_sample_ids(frame):
    df = frame([("CGL123S1T2",)], "s string")
    assert values(df, text.strip_from("s", "S")) == ["CGL123"]
    assert values(df, text.strip_from("s", "T")) == ["CGL123S1"]


def test_parentheses_and_number(frame):
    df = frame([("Doe, J (12345)",), ("Doe",), ("a (b) (7)",), ("()",)], "v string")
    inner = text.between_parentheses("v")
    assert values(df, inner) == ["12345", None, "b) (7", None]
    assert values(df, casting.to_long(inner)) == [12345, None, None, None]


def test_blank_policies(frame):
    df = frame([("",), (None,), ("x",)], "v string")
    assert values(df, text.empty_to("v", "d")) == ["d", None, "x"]
    assert values(df, text.null_to("v", "d")) == ["", "d", "x"]
    assert values(df, text.blank_to("v", "d")) == ["d", "d", "x"]


def test_contains_any(frame):
    df = frame([("a.c",), ("abc",), (None,)], "v string")
    assert values(df, text.contains_any("v", ["a.c"])) == [True, False, None]
    assert values(df, text.contains_any("v", ["a.c"], regex=True)) == [True, True, None]


@pytest.mark.parametrize(
    "raw, label",
    [
        ("Pathogenic/Likely pathogenic", "Likely pathogenic"),
        ("Benign/Likely benign", "Likely benign"),
        ("Conflicting interpretations of pathogenicity", "VUS"),
        ("not provided", "Not in ClinVar"),
        ("Other", "Benign"),
        ("Uncertain significance", "Uncertain significance"),
        ("Drug response|Benign", "Benign"),
        ("Pathogenic, Risk factor", "Risk factor"),
        ("Pathogenic", "Pathogenic"),
        ("", "Not in ClinVar"),
        ("Not in ClinVar", "Not in ClinVar"),
        (None, None),
    ],
)
def test_significance(frame, raw, label):
    assert values(frame([(raw,)], "v string"), normalize_significance("v")) == [label]


def test_significance_quirk_can_be_kept(frame):
    df = frame([("Not in ClinVar",)], "v string")
    assert values(df, normalize_significance("v", squeeze_blanks=False)) == ["Not  in ClinVar"]


def test_numbers(frame):
    df = frame([("0.4",), (" 1e-3 ",), ("abc",), ("1d",), ("NaN",), (None,)], "v string")
    assert values(df, casting.to_double("v")) == [0.4, 0.001, None, None, None, None]
    assert values(frame([("12.7",), ("9",), ("x",)], "v string"), casting.to_long("v")) == [12, 9, None]


@pytest.mark.parametrize(
    "raw, style, day",
    [
        ("03/31/19", "mdy2", dt.date(2019, 3, 31)),
        ("3/1/69", "mdy2", dt.date(1969, 3, 1)),
        ("3/1/68", "mdy2", dt.date(2068, 3, 1)),
        ("03/31/2019", "mdy2", None),
        ("190331", "ymd2", dt.date(2019, 3, 31)),
        ("991231", "ymd2", dt.date(1999, 12, 31)),
        ("1/2/2019", "mdy4", dt.date(2019, 1, 2)),
        ("2-13-2019", "mdy", dt.date(2019, 2, 13)),
        ("2.13.19", "mdy", dt.date(2019, 2, 13)),
        ("2019-02-13", "iso", dt.date(2019, 2, 13)),
        ("13/45/2019", "mdy4", None),
        ("soon", "mdy", None),
        (None, "iso", None),
    ],
)
def test_dates(frame, raw, style, day):
    assert values(frame([(raw,)], "v string"), casting.parse_date("v", style)) == [day]


def test_unknown_date_style():
    with pytest.raises(ValueError):
        casting.parse_date(F.lit("x"), "dmy")


@pytest.mark.parametrize("year, full", [("55", 1955), ("05", 2005), ("18", 2018), ("19", 1919), ("1915", 1915)])
def test_year_pivot(frame, year, full):
    df = frame([(f"1/2/{year}",)], "v string")
    got = values(df, casting.pivot_year(casting.parse_date("v", "mdy4"), 2018))
    assert got == [dt.date(full, 1, 2)]


@pytest.mark.parametrize(
    "start, end, months",
    [
        ("2019-01-31", "2019-02-28", 1),
        ("2019-01-30", "2019-02-28", 1),
        ("2019-01-15", "2019-02-14", 0),
        ("2019-01-15", "2019-02-15", 1),
        ("2020-02-29", "2021-02-28", 12),
        ("2019-03-15", "2019-03-15", 0),
    ],
)
def test_completed_months(frame, start, end, months):
    df = frame([(start, end)], "s string, e string").selectExpr("date(s) s", "date(e) e")
    assert values(df, dates.completed_months("s", "e")) == [months]


def test_open_follow_up_ends_at_the_censor_date(frame):
    df = frame([("2021-01-31", None)], "s string, e string").selectExpr("date(s) s", "date(e) e")
    assert values(df, dates.followed_months("s", "e", "2021-12-31")) == [11]


def test_rare_or_unknown(frame):
    df = frame([(0.00005,), (0.0001,), (None,)], "f double")
    assert values(df, predicates.rare_or_unknown("f")) == [True, False, True]


def test_normal_tails(frame):
    xs = [-4.0, -1.0, -0.2, 0.0, 0.5, 1.96, 5.0, 7.0]
    df = frame([(x,) for x in xs], "x double")
    for x, got in zip(xs, values(df, tails.erfc("x"))):
        assert got == pytest.approx(math.erfc(x), rel=2e-7)
    for x, got in zip(xs, values(df, tails.normal_cdf("x"))):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=2e-7)


def test_normal_quantile(frame):
    from statistics import NormalDist

    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.975, 0.9999]
    df = frame([(p,) for p in ps] + [(0.0,), (1.0,)], "p double")
    got = values(df, tails.normal_quantile("p"))
    assert got[:-2] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-8, abs=1e-9)
    assert got[-2:] == [None, None]


@pytest.mark.parametrize(
    "x, df_, p",
    [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
     (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0)],
)
def test_chi_square_tail(frame, x, df_, p):
    df = frame([(x,)], "x double")
    assert values(df, tails.chi_square_tail("x", df_)) == pytest.approx([p], rel=1e-6)


def test_chi_square_tail_of_many_degrees(frame):
    """Around the mean the tail is near a half, by the cube-root approximation; the long sum continues the short one."""
    import math

    for df in (42, 499, 4095):
        for z in (-2.0, 0.0, 2.5):
            x = df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3
            got = frame([(x,)], "x double").select(tails.chi_square_tail("x", df)).first()[0]
            assert abs(got - math.erfc(z / math.sqrt(2)) / 2) < 2e-3
    assert frame([(0.0,)], "x double").select(tails.chi_square_tail("x", 499)).first()[0] == 1.0


def test_significance_skips_patterns_that_cannot_match(spark, frame):
    """The guarded steps give what the plain chain of rewrites gives, and no pattern runs where its text does not occur."""
    parts = ["", "Benig", "Benign", "benignn", "Othe", "Other", "Pathogeni", "Pathogenic", "pathogenic", "pathogenicity", "VUS", "No", "Not",
             "Not provided", "Risk factor", "Ris", "Drug response", "provide", "  ", "\n", "x", "Not in ClinVar", "Likely "]
    texts = [a + b + c for a in parts for b in ("", "/", "\n", " ") for c in parts]
    df = frame([(x,) for x in [*texts, None]], "v string")
    plain = F.col("v")
    for pattern, wording in significance.REWRITES:
        plain = F.regexp_replace(plain, significance._anchored(pattern), wording)
    plain = F.regexp_replace(F.regexp_replace(plain, " {2,}", " "), "^$", significance.ABSENT)
    plain = F.regexp_replace(plain, significance._anchored(significance.ABSENT_PATTERN), significance.ABSENT)
    for marker, wording in significance.WHOLE_VALUE:
        plain = F.regexp_replace(plain, f"(?s)^.*{marker}.*$", wording)
    got = normalize_significance("v")
    assert df.filter(~got.eqNullSafe(plain)).select("v", got, plain).collect() == []
    shown = df.select(got)._jdf.queryExecution().analyzed().toString()
    assert shown.lower().count("contains(") >= len(significance.REWRITES)
