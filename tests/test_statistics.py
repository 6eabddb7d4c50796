import math
import os
import random
import subprocess
import sys
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pytest

from cohortline.operators import cox, ranktests, risksets, roc, survival

SMALL = [(1, True), (2, True), (2, False), (3, True), (4, False)]


@pytest.fixture
def small(frame):
    return frame(SMALL, "t int, e boolean")


def test_km_small(small):
    curve = survival.km_curve(small, "t", "e").orderBy("time").collect()
    assert [r.n_risk for r in curve] == [5, 4, 2, 1]
    assert [r.survival for r in curve] == pytest.approx([0.8, 0.6, 0.3, 0.3])
    # Greenwood at t = 2: 1/(5*4) + 1/(4*3)
    assert curve[1].std_err == pytest.approx(0.6 * math.sqrt(1 / 20 + 1 / 12))
    assert curve[1].upper <= 1 and curve[1].lower == pytest.approx(0.6 * math.exp(-1.959964 * math.sqrt(1 / 20 + 1 / 12)), rel=1e-5)
    assert all(a.survival >= b.survival for a, b in zip(curve, curve[1:]))


def test_km_reaches_zero(frame):
    df = frame([(1, True), (2, True)], "t int, e boolean")
    curve = survival.km_curve(df, "t", "e").orderBy("time")
    last = curve.collect()[-1]
    assert (last.survival, last.std_err, last.lower, last.upper) == (0.0, None, None, None)
    assert survival.km_cumhaz(curve).orderBy("time").collect()[-1].cumhaz is None
    assert survival.nelson_aalen(df, "t", "e").orderBy("time").collect()[-1].cumhaz == 1.5


def test_km_at(small):
    curve = survival.km_curve(small, "t", "e")
    got = {r.horizon: r for r in survival.km_at(curve, [0, 2, 3, 9]).collect()}
    assert sorted(got) == [0, 2, 3]
    assert (got[0].survival, got[0].std_err, got[0].lower, got[0].n_risk) == (1.0, 0.0, 1.0, 5)
    assert (got[2].survival, got[2].n_risk) == (pytest.approx(0.6), 4)
    extended = {r.horizon: r for r in survival.km_at(curve, [9], extend=True).collect()}
    assert (extended[9].survival, extended[9].n_risk) == (pytest.approx(0.3), 0)


def test_risk_table(small):
    assert sorted(tuple(r) for r in survival.risk_table(small, "t", [0, 2, 4, 6]).collect()) == [
        (0, 5), (2, 4), (4, 1), (6, 0)
    ]


def test_many_horizons(frame):
    """Every horizon as a loop over the curve would find it, groups that end early and missing groups included."""
    rng = random.Random(2)
    df = frame([(rng.choice([1.5, 2.0, 3.25, 7.0, 11.5, 30.0]) + (g == "b"), rng.random() < 0.5, g) for g in ("a", "b", None) for _ in range(60)],
               "t double, e boolean, g string")
    curve = survival.km_curve(df, "t", "e", "g")
    steps, times = curve.collect(), [r.t for r in df.collect()]
    horizons = sorted({rng.uniform(-1, 35) for _ in range(300)} | {2.0, 3.0, 7.0, 31.0})
    for extend in (False, True):
        got = {(r.g, r.horizon): r for r in survival.km_at(curve, horizons, "g", extend).collect()}
        for g in ("a", "b", None):
            mine = sorted((r for r in steps if r.g == g), key=lambda r: r.time)
            for h in horizons:
                before = [r for r in mine if r.time <= h]
                if h > mine[-1].time and not extend:
                    assert (g, h) not in got
                    continue
                want = (before[-1].survival, before[-1].std_err, before[-1].lower, before[-1].upper) if before else (1.0, 0.0, 1.0, 1.0)
                after = [r.n_risk for r in mine if r.time >= h]
                assert tuple(got[g, h])[2:] == (*want, after[0] if after else 0)
    table = {(r.g, r.horizon): r.n_risk for r in survival.risk_table(df, "t", horizons, "g").collect()}
    followed = [(r.g, r.t) for r in df.collect()]
    assert table == {(g, h): sum(x == g and t >= h for x, t in followed) for g in ("a", "b", None) for h in horizons}
    plan = survival.km_at(curve, horizons, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan.split("max_by")[-1]  # no step is multiplied


def test_fractional_time(frame):
    rng = random.Random(8)
    whole = [(rng.randrange(1, 40), rng.random() < 0.6, rng.choice("ab")) for _ in range(200)]
    parts = [(t / 12, e, g) for t, e, g in whole]
    a = survival.km_curve(frame(whole, "t int, e boolean, g string"), "t", "e", "g").orderBy("g", "time").collect()
    b = survival.km_curve(frame(parts, "t double, e boolean, g string"), "t", "e", "g").orderBy("g", "time").collect()
    assert [r.n_risk for r in a] == [r.n_risk for r in b]
    assert [r.survival for r in a] == pytest.approx([r.survival for r in b])
    tests = [survival.logrank(frame(rows, f"t {kind}, e boolean, g string"), "t", "e", "g").first() for rows, kind in ((whole, "int"), (parts, "double"))]
    assert tests[0].chi2 == pytest.approx(tests[1].chi2)


def test_survival_plans_have_no_window_over_all_times(frame):
    df = frame([(1.5, True, "a"), (2.5, False, "b")], "t double, e boolean, g string")
    for result in (survival.km_curve(df, "t", "e"), survival.logrank(df, "t", "e", "g", ["a", "b"])):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Window" in line and "specifiedwindowframe" in line and "time" in line.split("windowspecdefinition(")[-1].split(",")[0]]


def test_unlisted_levels_raise(frame):
    df = frame([(i % 7, i % 2 == 0, "abcd"[i % 4]) for i in range(60)], "t int, e boolean, g string")
    with pytest.raises(Exception, match="30 rows have a level that is not listed"):
        survival.logrank(df, "t", "e", "g", ["a", "b"]).collect()
    with pytest.raises(ValueError, match="30 rows"):
        cox.cox_ph(df, "t", "e", ["g"], levels={"g": ["a", "b"]})
    assert survival.logrank(df.filter("g IN ('a', 'b')"), "t", "e", "g", ["a", "b"]).first().n == 30


def test_logrank_over_several_columns(frame):
    rng = random.Random(3)
    data = [(rng.randrange(1, 9), rng.random() < 0.6, rng.choice("ab"), rng.choice([0, 1, None])) for _ in range(150)]
    df = frame(data, "t int, e boolean, g string, h int")
    one = df.filter("h IS NOT NULL").selectExpr("t", "e", "concat(g, h) AS gh")
    got, want = survival.logrank(df, "t", "e", ["g", "h"]).first(), survival.logrank(one, "t", "e", "gh").first()
    assert got.df == 3 and got.n == want.n and got.chi2 == pytest.approx(want.chi2)


def test_logrank_small(frame):
    df = frame([(1, "A"), (3, "A"), (2, "B"), (4, "B")], "t int, g string").selectExpr("*", "true AS e")
    got = survival.logrank(df, "t", "e", "g").first()
    assert (got.n, got.events, got.df) == (4, 4, 1)
    assert got.chi2 == pytest.approx(8 / 13)
    assert got.p == pytest.approx(math.erfc(math.sqrt(8 / 26)), rel=1e-6)


def brute_logrank(data, levels):
    k = len(levels)
    u, v = np.zeros(k), np.zeros((k, k))
    for t in sorted({t for t, e, _ in data if e}):
        n = np.array([sum(1 for s, _, g in data if s >= t and g == l) for l in levels], float)
        d = np.array([sum(1 for s, e, g in data if s == t and e and g == l) for l in levels], float)
        total, dead = n.sum(), d.sum()
        u += d - n * dead / total
        if total > 1:
            c = dead * (total - dead) / (total - 1)
            v += c * (np.diag(n / total) - np.outer(n, n) / total**2)
    return u[:-1] @ np.linalg.solve(v[:-1, :-1], u[:-1])


@pytest.mark.parametrize("levels", ["ab", "abc", "abcde"])
def test_logrank_equals_brute_force(frame, levels):
    rng = random.Random(len(levels))
    data = [(rng.randrange(1, 15), rng.random() < 0.6, rng.choice(levels)) for _ in range(150)]
    got = survival.logrank(frame(data, "t int, e boolean, g string"), "t", "e", "g").first()
    assert got.df == len(levels) - 1
    assert got.chi2 == pytest.approx(brute_logrank(data, levels))


def test_many_groups_and_covariates(frame):
    """Five hundred groups, and five covariates of more combinations than subjects, in several ranges and blocks of cells."""
    rng = random.Random(12)
    data = [(rng.randrange(1, 60), rng.random() < 0.5, f"g{i % 500}") for i in range(2500)]
    got = survival.logrank(frame(data, "t int, e boolean, g string"), "t", "e", "g").first()
    assert got.df == 499 and got.chi2 == pytest.approx(brute_logrank(data, sorted({g for _, _, g in data})), rel=1e-6)
    names = "pqrsu"
    rows = [(rng.randrange(1, 25), rng.random() < 0.6, *[rng.choice("xyzuv"[:3 + i % 3]) for i in range(5)]) for _ in range(300)]
    df = frame(rows, "t int, e boolean, " + ", ".join(f"{c} string" for c in names))
    table = cox.cox_ph(df, "t", "e", list(names))
    assert table.count() == sum(len({r[i] for r in rows}) - 1 for i in range(2, 7)) and table.first().converged


def test_blocks_of_cells_add_up(frame, monkeypatch):
    rng = random.Random(7)
    data = [(rng.randrange(1, 80), rng.random() < 0.5, "abcde"[i % 5]) for i in range(400)]
    sets = risksets.long_risk_sets(frame(data, "t int, e boolean, g string"), "t", "e", risksets.pattern_number({"g": "abcde"}))
    rows = sets.collect()
    assert len(rows) > 4 and sum(sum(r.n) for r in rows) == 400
    for cells in (1, 30, 1 << 20):
        monkeypatch.setattr(risksets, "CELLS", cells)
        for r in rows:
            got = [(d.tolist(), n.tolist()) for deaths, risk, _ in risksets._blocks(r) for d, n in zip(deaths, risk)]
            times = sorted({t for t in r.time if any(s == t and e for s, e, _ in data)})
            want = [([sum(e and s == t and g == x for s, e, g in data) for x in "abcde"], [sum(s >= t and g == x for s, e, g in data) for x in "abcde"]) for t in times]
            known = [block[2].tolist() for block in risksets._blocks(r)]
            want = [([d[i] for i in known[0]], [n[i] for i in known[0]]) for d, n in want]
            assert sorted(got, reverse=True) == sorted(want, reverse=True)


def brute_cox(data, columns, ties):
    """Newton's method on the written-out partial likelihood, row by row."""
    x = np.array([[float(f(r)) for f in columns] for r in data])
    t, e = np.array([r[0] for r in data]), np.array([r[1] for r in data])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        w = np.exp(x @ beta)
        u, v = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for s in sorted(set(t[e])):
            risk, dead = t >= s, (t == s) & e
            m = dead.sum()
            for i in range(m):
                f = i / m if ties == "efron" else 0.0
                weight = w * risk - f * w * dead
                mu = weight @ x / weight.sum()
                u -= mu
                v += (x * weight[:, None]).T @ x / weight.sum() - np.outer(mu, mu)
            u += x[dead].sum(axis=0)
        step = np.linalg.solve(v, u)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(v)))


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_equals_brute_force(frame, ties):
    rng = random.Random(4)
    # few distinct times: some carry more ties than are summed one by one
    data = [(rng.randrange(1, 5), rng.random() < 0.7, rng.choice("abc"), rng.choice("xy")) for _ in range(400)]
    table = cox.cox_ph(
        frame(data, "t int, e boolean, g string, h string"), "t", "e", ["g", "h"],
        reference={"g": "b"}, ties=ties,
    )
    got = {(r.term, r.level): r for r in table.collect()}
    columns = [lambda r: r[2] == "a", lambda r: r[2] == "c", lambda r: r[3] == "y"]
    beta, se = brute_cox(data, columns, ties)
    keys = [("g", "a"), ("g", "c"), ("h", "y")]
    assert [got[k].coef for k in keys] == pytest.approx(list(beta), abs=1e-8)
    assert [got[k].std_err for k in keys] == pytest.approx(list(se), abs=1e-8)
    assert got[keys[0]].hazard_ratio == pytest.approx(math.exp(beta[0]))
    assert got[keys[0]].p == pytest.approx(math.erfc(abs(beta[0] / se[0]) / math.sqrt(2)))


@pytest.mark.parametrize("risk, dying, deaths", [(100.0, 40.0, 40), (1e9, 50.0, 50), (60.0, 60.0, 60), (500.0, 3.7, 33), (7.0, 2.0, 1), (9.0, 5.0, 2)])
def test_tie_sums_closed_form(risk, dying, deaths):
    r = [risk - i / deaths * dying for i in range(deaths)]
    got = cox.tie_sums(np.array([risk]), np.array([dying]), np.array([float(deaths)]))
    expected = (math.fsum(1 / a for a in r), math.fsum(1 / a**2 for a in r), math.fsum(map(math.log, r)))
    assert [float(g[0]) for g in got] == pytest.approx(expected, rel=1e-11)


def test_cox_reports_separation(frame):
    data = [(1, True, "a"), (2, True, "a"), (5, False, "b"), (6, False, "b")]
    row = cox.cox_ph(frame(data, "t int, e boolean, g string"), "t", "e", ["g"]).first()
    assert not row.converged and row.coef == -math.inf and row.std_err is None


def test_cox_leaves_aliased_terms_empty(frame):
    rng = random.Random(6)
    data = [(rng.randrange(1, 30), rng.random() < 0.6, rng.choice("ab")) for _ in range(200)]
    data = [(t, e, g, "yes" if g == "b" else "no") for t, e, g in data]
    df = frame(data, "t int, e boolean, g string, h string")
    alone = cox.cox_ph(df, "t", "e", ["g"]).first()
    both = {r.term: r for r in cox.cox_ph(df, "t", "e", ["g", "h"]).collect()}
    assert both["g"].coef == pytest.approx(alone.coef) and both["g"].converged
    assert both["h"].coef is None and both["h"].p is None


def test_cox_runs_outside_the_repository(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate()\n"
        "from cohortline.operators.cox import cox_ph\n"
        "df = spark.createDataFrame([(1, True, 'a'), (2, True, 'b'), (3, True, 'a'), (4, False, 'b')], 't int, e boolean, g string')\n"
        "print('coefficient', cox_ph(df, 't', 'e', ['g']).first().coef)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "coefficient" in done.stdout, done.stderr[-2000:]


def test_kruskal_small(frame):
    df = frame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (4.0, "b"), (5.0, "c"), (6.0, "c")], "v double, g string")
    got = ranktests.kruskal_wallis(df, "v", "g").first()
    assert (got.n, got.df) == (6, 2)
    assert got.h == pytest.approx(32 / 7)
    assert got.p == pytest.approx(math.exp(-16 / 7))


def test_kruskal_with_ties_equals_brute_force(frame):
    rng = random.Random(6)
    data = [(float(rng.randrange(8)), rng.choice("abc")) for _ in range(200)]
    values = sorted(v for v, _ in data)
    rank = {v: (2 * values.index(v) + values.count(v) + 1) / 2 for v in set(values)}
    n = len(data)
    h = 12 / (n * (n + 1)) * sum(
        sum(rank[v] for v, g in data if g == s) ** 2 / sum(1 for _, g in data if g == s) for s in "abc"
    ) - 3 * (n + 1)
    h /= 1 - sum(values.count(v) ** 3 - values.count(v) for v in set(values)) / (n**3 - n)
    got = ranktests.kruskal_wallis(frame(data, "v double, g string"), "v", "g", 3).first()
    assert got.h == pytest.approx(h)


def test_roc_small(frame):
    df = frame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "s double, l int")
    assert roc.auc_empirical(df, "s", "l").first().auc == 1.0
    assert tuple(roc.ks_stat(df, "s", "l").first()) == (1.0, 3.0)
    at = {r.cutoff: r for r in roc.cutoff_metrics(df, "s", "l").collect()}
    assert (at[3.0].sens, at[3.0].spec, at[3.0].acc, at[3.0].pdlr) == (1.0, 1.0, 1.0, None)
    assert (at[1.0].sens, at[1.0].spec, at[1.0].npv) == (1.0, 0.0, None)


def test_roc_direction(frame):
    rng = random.Random(9)
    data = [(float(rng.randrange(6)) + label, label) for label in (0, 1) for _ in range(60)]
    df = frame(data, "s double, l int")
    pairs = [(a, b) for a, la in data if la for b, lb in data if not lb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert roc.auc_empirical(df, "s", "l").first().auc == pytest.approx(auc)
    assert roc.auc_empirical(df, "s", "l", False).first().auc == pytest.approx(1 - auc)
    up, down = (roc.class_moments(df, "s", "l", d).first().auc for d in (True, False))
    assert up == pytest.approx(1 - down, abs=1e-6) and up > 0.5


def test_binormal_against_the_normal_distribution(frame):
    from statistics import NormalDist, mean, stdev

    pos, neg = [3.0, 4.0, 6.0, 5.0], [1.0, 2.0, 4.0, 2.5]
    df = frame([(x, 1) for x in pos] + [(x, 0) for x in neg], "s double, l int")
    a, b = (mean(pos) - mean(neg)) / stdev(pos), stdev(neg) / stdev(pos)
    nd = NormalDist()
    curve = {round(r.fpr, 2): r for r in roc.roc_binormal(df, "s", "l").collect()}
    assert len(curve) == 99
    for fpr in (0.01, 0.3, 0.9):
        assert curve[fpr].tpr == pytest.approx(nd.cdf(a + b * nd.inv_cdf(fpr)), abs=1e-6)
    auc = nd.cdf(a / math.sqrt(1 + b * b))
    assert curve[0.3].auc == pytest.approx(auc, abs=1e-6)
    ci = roc.auc_ci(roc.class_moments(df, "s", "l")).first()
    q1, q2 = auc / (2 - auc), 2 * auc**2 / (1 + auc)
    se = math.sqrt((auc * (1 - auc) + 3 * (q1 - auc**2) + 3 * (q2 - auc**2)) / 16)
    assert ci.std_err == pytest.approx(se, abs=1e-6) and ci.upper <= 1.0
    band = roc.roc_ci(df, "s", "l").collect()
    assert all(0 <= r.lower <= r.tpr <= r.upper <= 1 for r in band)


def test_auc_of_very_many(frame):
    model = frame([(0.8, 4_000_000_000, 4_000_000_000)], "auc double, n_pos long, n_neg long")
    row = roc.auc_ci(model).first()
    assert 0 < row.std_err < 1e-4


def plain_delong(data):
    pos, neg = [x for x, y in data if y], [x for x, y in data if not y]
    wins = np.array([[(x > z) + 0.5 * (x == z) for z in neg] for x in pos])
    return wins.mean(), math.sqrt(wins.mean(axis=1).var(ddof=1) / len(pos) + wins.mean(axis=0).var(ddof=1) / len(neg))


@pytest.mark.parametrize("higher", [True, False])
def test_delong_equals_all_pairs(frame, higher):
    rng = random.Random(4)
    data = [(rng.randrange(12) + (1.5 if y else 0.0), int(y)) for y in (rng.random() < 0.4 for _ in range(120))]
    got = roc.auc_delong(frame(data + [(None, 1), (3.0, None)], "x double, y int"), "x", "y", higher).first()
    auc, se = plain_delong(data)
    assert (got.auc, got.std_err) == pytest.approx((auc if higher else 1 - auc, se)) and (got.n_pos, got.n_neg) == (sum(y for _, y in data), sum(1 - y for _, y in data))
    assert got.upper == pytest.approx(min(1, got.auc + 1.959963984540054 * se))
    one = roc.auc_delong(frame([(1.0, 1), (2.0, 0), (3.0, 0)], "x double, y int"), "x", "y").first()
    assert one.auc == 0.0 and one.std_err is None  # a class of one has no variance
    assert roc.auc_delong(frame([], "x double, y int"), "x", "y").first().auc is None


def test_smooth_curve_is_near_the_true_one(frame):
    """Two normal classes: the smooth curve follows theirs; direction turns it; constant scores have a curve too."""
    rng = random.Random(6)
    data = [(rng.gauss(1.0 if y else 0.0, 1.0), y) for y in [0, 1] * 1500]
    curve = roc.roc_smooth(frame(data, "x double, y int"), "x", "y").orderBy("cutoff").collect()
    assert len(curve) == 512 and curve[0].tpr == curve[0].fpr == 1.0
    assert all(a.tpr >= b.tpr and a.fpr >= b.fpr for a, b in zip(curve, curve[1:]))
    normal = NormalDist()
    assert curve[0].auc == pytest.approx(normal.cdf(1 / math.sqrt(2)), abs=0.02)
    for r in curve[::25]:
        assert r.tpr == pytest.approx(1 - normal.cdf(r.cutoff - 1), abs=0.04) and r.fpr == pytest.approx(1 - normal.cdf(r.cutoff), abs=0.04)
    turned = roc.roc_smooth(frame([(-x, y) for x, y in data], "x double, y int"), "x", "y", False).first()
    assert turned.auc == pytest.approx(curve[0].auc)
    assert roc.roc_smooth(frame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, y int"), "x", "y").first().auc == pytest.approx(0.5, abs=0.01)
