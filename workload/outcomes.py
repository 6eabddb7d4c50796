"""Survival of followed subjects."""

from pyspark.sql import functions as F

from cohortline.operators import cox, survival
from workload.base import FOLLOWED, erfc_sql, followed, query, rounded

Z95 = "1.959963984540054"
ARMS = ["F", "O", "P"]

CURVE = f"""WITH {FOLLOWED}, counts AS (
  SELECT arm, months AS time, count(*) FILTER (died) AS n_event, count(*) FILTER (NOT died) AS n_censor
  FROM followed GROUP BY 1, 2),
risk AS (SELECT *, CAST(sum(n_event + n_censor) OVER (PARTITION BY arm ORDER BY time DESC) AS BIGINT) AS n_risk FROM counts),
steps AS (SELECT *, product(1.0 - n_event / n_risk) OVER w AS survival,
  sum(CASE WHEN n_risk > n_event THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END) OVER w AS g
  FROM risk WINDOW w AS (PARTITION BY arm ORDER BY time)),
curve AS (SELECT arm, time, n_risk, n_event, n_censor, survival,
  CASE WHEN survival > 0 THEN survival * sqrt(g) END AS std_err,
  CASE WHEN survival > 0 THEN survival * exp(-{Z95} * sqrt(g)) END AS lower,
  CASE WHEN survival > 0 THEN least(1.0, survival * exp({Z95} * sqrt(g))) END AS upper FROM steps)"""


@query(f"""{CURVE} SELECT arm, time, n_risk, n_event, n_censor, round(survival, 6) AS survival,
  round(std_err, 6) AS std_err, round(lower, 6) AS lower, round(upper, 6) AS upper FROM curve""")
def km_curve(t):
    curve = survival.km_curve(followed(t), "months", "died", "arm")
    return rounded(curve, "survival", "std_err", "lower", "upper")


@query(f"""{CURVE}, asked AS (SELECT arm, horizon FROM (SELECT DISTINCT arm FROM curve) CROSS JOIN (VALUES (24), (48), (72)) v(horizon)),
last AS (SELECT a.arm, a.horizon, max(c.time) AS time FROM asked a LEFT JOIN curve c ON a.arm = c.arm AND c.time <= a.horizon GROUP BY 1, 2)
SELECT l.arm, l.horizon, CASE WHEN l.time IS NULL THEN 1.0 ELSE round(c.survival, 6) END AS survival,
  CASE WHEN l.time IS NULL THEN 0.0 ELSE round(c.std_err, 6) END AS std_err,
  CASE WHEN l.time IS NULL THEN 1.0 ELSE round(c.lower, 6) END AS lower,
  CASE WHEN l.time IS NULL THEN 1.0 ELSE round(c.upper, 6) END AS upper,
  (SELECT count(*) FROM followed f WHERE f.arm = l.arm AND f.months >= l.horizon) AS n_risk
FROM last l LEFT JOIN curve c ON l.arm = c.arm AND l.time = c.time
WHERE l.horizon <= (SELECT max(time) FROM curve m WHERE m.arm = l.arm)""")
def km_at(t):
    curve = survival.km_curve(followed(t), "months", "died", "arm")
    return rounded(
        survival.km_at(curve, [24, 48, 72], "arm"), "survival", "std_err", "lower", "upper"
    )


@query(f"""{CURVE} SELECT arm, time, round(CASE WHEN survival > 0 THEN -ln(survival) END, 6) AS cumhaz FROM curve""")
def km_cumhaz(t):
    curve = survival.km_curve(followed(t), "months", "died", "arm")
    return rounded(survival.km_cumhaz(curve, "arm"), "cumhaz")


@query(f"""{CURVE} SELECT arm, time, round(sum(n_event / n_risk) OVER (PARTITION BY arm ORDER BY time), 6) AS cumhaz FROM curve""")
def nelson_aalen(t):
    return rounded(survival.nelson_aalen(followed(t), "months", "died", "arm"), "cumhaz")


@query(f"""WITH {FOLLOWED}, counts AS (
  SELECT months * 365.25 / 12 AS time, count(*) FILTER (died) AS d, count(*) AS m FROM followed GROUP BY 1),
risk AS (SELECT time, d, CAST(sum(m) OVER (ORDER BY time DESC) AS BIGINT) AS n_risk FROM counts)
SELECT round(time, 6) AS time, n_risk, round(product(1.0 - d / n_risk) OVER (ORDER BY time), 6) AS survival FROM risk""")
def km_fractional(t):
    """One curve over days, a time scale of fractions."""
    days = followed(t).withColumn("days", F.col("months") * 365.25 / 12)
    return rounded(survival.km_curve(days, "days", "died").select("time", "n_risk", "survival"), "time", "survival")


@query(f"""WITH {FOLLOWED}, grid AS (SELECT * FROM (VALUES (0), (12), (24), (36), (48), (60), (72)) v(horizon))
SELECT arm, horizon, count(*) FILTER (months >= horizon) AS n_risk FROM followed CROSS JOIN grid GROUP BY 1, 2""")
def risk_table(t):
    return survival.risk_table(followed(t), "months", range(0, 73, 12), "arm")


@query(f"""WITH {FOLLOWED}, times AS (
  SELECT months AS time, count(*) AS m, count(*) FILTER (arm = 'F') AS m0, count(*) FILTER (arm = 'O') AS m1,
    count(*) FILTER (died) AS d, count(*) FILTER (died AND arm = 'F') AS d0, count(*) FILTER (died AND arm = 'O') AS d1
  FROM followed GROUP BY 1),
risk AS (SELECT d, d0, d1, sum(m) OVER w AS n, sum(m0) OVER w AS n0, sum(m1) OVER w AS n1 FROM times WINDOW w AS (ORDER BY time DESC)),
parts AS (SELECT *, n0 / n AS p0, n1 / n AS p1, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS c FROM risk),
sums AS (SELECT max(n) AS n, sum(d) AS events, sum(d0 - d * p0) AS u0, sum(d1 - d * p1) AS u1,
  sum(c * p0 * (1 - p0)) AS v00, sum(-c * p0 * p1) AS v01, sum(c * p1 * (1 - p1)) AS v11 FROM parts),
stat AS (SELECT *, (u0 * u0 * v11 - 2 * u0 * u1 * v01 + u1 * u1 * v00) / (v00 * v11 - v01 * v01) AS x FROM sums)
SELECT CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events, round(x, 6) AS chi2, 2 AS df, round(exp(-x / 2), 6) AS p FROM stat""")
def logrank(t):
    return rounded(survival.logrank(followed(t), "months", "died", "arm", ARMS), "chi2", "p")


@query(f"""WITH {FOLLOWED}, times AS (
  SELECT months AS time, count(*) AS m, count(*) FILTER (volume = 'few') AS m0,
    count(*) FILTER (died) AS d, count(*) FILTER (died AND volume = 'few') AS d0 FROM followed GROUP BY 1),
risk AS (SELECT d, d0, sum(m) OVER w AS n, sum(m0) OVER w AS n0 FROM times WINDOW w AS (ORDER BY time DESC)),
sums AS (SELECT max(n) AS n, sum(d) AS events, sum(d0 - d * n0 / n) AS u,
  sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n0 / n) * (1 - n0 / n) ELSE 0 END) AS v FROM risk),
stat AS (SELECT *, u * u / v AS x FROM sums)
SELECT CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events, round(x, 6) AS chi2, 1 AS df,
  round({erfc_sql("sqrt(x / 2.0)")}, 6) AS p FROM stat""")
def logrank_two(t):
    test = survival.logrank(followed(t), "months", "died", "volume", ["few", "many"])
    return rounded(test, "chi2", "p")


def newton_sql(ties: str, steps: int = 8) -> str:
    """Newton steps for one binary covariate, unrolled; risk weights are n0 + n1 * exp(beta)."""
    if ties == "breslow":
        spread = "SELECT d AS w, 0.0 AS f, * FROM risk WHERE d > 0"
    else:
        spread = "SELECT 1 AS w, i / d AS f, * FROM risk, range(d) r(i) WHERE d > 0"
    parts = [
        f"""WITH {FOLLOWED}, times AS (
  SELECT months AS time, count(*) FILTER (volume = 'few') AS m0, count(*) FILTER (volume = 'many') AS m1,
    count(*) FILTER (died) AS d, count(*) FILTER (died AND volume = 'few') AS d0,
    count(*) FILTER (died AND volume = 'many') AS d1 FROM followed GROUP BY 1),
risk AS (SELECT d, d0, d1, sum(m0) OVER w AS n0, sum(m1) OVER w AS n1 FROM times WINDOW w AS (ORDER BY time DESC)),
spread AS ({spread}),
observed AS (SELECT sum(d1) AS o, sum(d) AS events, max(n0 + n1) AS n FROM risk),
b0 AS (SELECT 0.0::DOUBLE AS b)"""
    ]
    for i in range(steps):
        share = "((n1 - f * d1) * exp(b) / ((n0 - f * d0) + (n1 - f * d1) * exp(b)))"
        parts.append(
            f"b{i + 1} AS (SELECT max(b) + ((SELECT o FROM observed) - sum(w * {share}))"
            f" / sum(w * {share} * (1 - {share})) AS b,"
            f" 1 / sqrt(sum(w * {share} * (1 - {share}))) AS se FROM spread, b{i})"
        )
    return (
        ",\n".join(parts)
        + f""" SELECT 'volume' AS term, 'many' AS level, round(b, 5) AS coef, round(exp(b), 5) AS hazard_ratio,
  round(se, 5) AS std_err, round(exp(b - {Z95} * se), 5) AS lower, round(exp(b + {Z95} * se), 5) AS upper,
  CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events FROM b{steps}, observed"""
    )


def fitted(t, ties):
    table = cox.cox_ph(
        followed(t), "months", "died", ["volume"], {"volume": "few"},
        {"volume": ["few", "many"]}, ties=ties,
    )
    wide = ["coef", "hazard_ratio", "std_err", "lower", "upper"]
    return table.drop("z", "p", "iterations", "converged").withColumns({c: F.round(c, 5) for c in wide})


@query(newton_sql("efron"))
def cox_efron(t):
    return fitted(t, "efron")


@query(newton_sql("breslow"))
def cox_breslow(t):
    return fitted(t, "breslow")


#: the groups of arm and volume, each with its indicators of the three terms
COMBINATIONS = [(arm, volume) for arm in ARMS for volume in ("few", "many")]


def newton_three_sql(steps: int = 8) -> str:
    """Newton steps for three indicators with Efron's ties, unrolled; the 3×3 information is inverted by its adjugate."""
    marks = [[int(arm == "F"), int(arm == "P"), int(volume == "many")] for arm, volume in COMBINATIONS]
    groups = range(len(COMBINATIONS))
    counted = ", ".join(
        f"count(*) FILTER (arm = '{arm}' AND volume = '{volume}') AS m{g},"
        f" count(*) FILTER (died AND arm = '{arm}' AND volume = '{volume}') AS d{g}"
        for g, (arm, volume) in enumerate(COMBINATIONS)
    )
    at_risk = ", ".join(f"sum(m{g}) OVER w AS n{g}" for g in groups)
    weight = [f"(n{g} - f * d{g}) * exp({' + '.join(f'{x} * b{j}' for j, x in enumerate(marks[g]))})" for g in groups]
    pairs = [(j, k) for j in range(3) for k in range(j, 3)]

    def total(keep) -> str:
        return " + ".join(weight[g] for g in groups if keep(marks[g]))

    parts = [
        f"""WITH {FOLLOWED}, times AS (
  SELECT months AS time, count(*) FILTER (died) AS d, {counted} FROM followed WHERE arm IN ('F', 'O', 'P') GROUP BY 1),
risk AS (SELECT d, {", ".join(f"d{g}" for g in groups)}, {at_risk} FROM times WINDOW w AS (ORDER BY time DESC)),
spread AS (SELECT i / d AS f, * FROM risk, range(d) r(i) WHERE d > 0),
observed AS (SELECT sum(d) AS events, max({" + ".join(f"n{g}" for g in groups)}) AS n,
  {", ".join(f"sum({' + '.join(f'd{g}' for g in groups if marks[g][j])}) AS o{j}" for j in range(3))} FROM risk),
s0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"""
    ]
    for i in range(steps):
        sums = ", ".join(
            [f"({total(lambda x: True)}) AS t"]
            + [f"({total(lambda x, j=j: x[j])}) AS t{j}" for j in range(3)]
            + [f"({total(lambda x, j=j, k=k: x[j] and x[k]) or '0.0'}) AS t{j}{k}" for j, k in pairs]
        )
        moments = ", ".join(
            [f"sum(t{j} / t) AS e{j}" for j in range(3)]
            + [f"sum(t{j}{k} / t - t{j} * t{k} / t / t) AS v{j}{k}" for j, k in pairs]
        )
        parts.append(
            f"w{i} AS (SELECT b0, b1, b2, {sums} FROM spread, s{i}),\n"
            f"m{i} AS (SELECT max(b0) AS b0, max(b1) AS b1, max(b2) AS b2, {moments} FROM w{i}),\n"
            f"a{i} AS (SELECT *, v11 * v22 - v12 * v12 AS c00, v02 * v12 - v01 * v22 AS c01, v01 * v12 - v02 * v11 AS c02,"
            f" v00 * v22 - v02 * v02 AS c11, v01 * v02 - v00 * v12 AS c12, v00 * v11 - v01 * v01 AS c22,"
            f" o0 - e0 AS u0, o1 - e1 AS u1, o2 - e2 AS u2 FROM m{i}, observed),\n"
            f"i{i} AS (SELECT *, v00 * c00 + v01 * c01 + v02 * c02 AS det FROM a{i}),\n"
            f"s{i + 1} AS (SELECT b0 + (c00 * u0 + c01 * u1 + c02 * u2) / det AS b0, b1 + (c01 * u0 + c11 * u1 + c12 * u2) / det AS b1,"
            f" b2 + (c02 * u0 + c12 * u1 + c22 * u2) / det AS b2,"
            f" sqrt(c00 / det) AS se0, sqrt(c11 / det) AS se1, sqrt(c22 / det) AS se2 FROM i{i})"
        )
    rows = " UNION ALL ".join(
        f"SELECT '{term}' AS term, '{level}' AS level, b{j} AS b, se{j} AS se FROM s{steps}"
        for j, (term, level) in enumerate((("arm", "F"), ("arm", "P"), ("volume", "many")))
    )
    return (
        ",\n".join(parts)
        + f""", terms AS ({rows})
SELECT term, level, round(b, 5) AS coef, round(exp(b), 5) AS hazard_ratio, round(se, 5) AS std_err,
  round(b / se, 4) AS z, round({erfc_sql("abs(b / se) / sqrt(2.0)")}, 5) AS p,
  round(exp(b - {Z95} * se), 5) AS lower, round(exp(b + {Z95} * se), 5) AS upper,
  CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events FROM terms, observed"""
    )


@query(newton_three_sql())
def cox_two_covariates(t):
    table = cox.cox_ph(
        followed(t), "months", "died", ["arm", "volume"], {"arm": "O", "volume": "few"},
        {"arm": ARMS, "volume": ["few", "many"]},
    )
    wide = ["coef", "hazard_ratio", "std_err", "lower", "upper"]
    rounding = {c: F.round(c, 5) for c in [*wide, "p"]} | {"z": F.round("z", 4)}
    return table.drop("iterations", "converged").withColumns(rounding)
