"""Separation of classes by a score, and rank tests."""

from pyspark.sql import functions as F

from cohortline.functions.tails import QUANTILE_TAIL_START
from cohortline.operators import ranktests, roc
from cohortline.functions import tails
from workload.base import SCORED, erfc_sql, normal_cdf_sql, query, rounded, scored

Z95 = "1.959963984540054"


@query("""WITH ranked AS (
  SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r,
         count(*) OVER (PARTITION BY o_totalprice) AS t, count(*) OVER () AS n FROM orders),
groups AS (SELECT g, count(*) AS m, sum(CAST(r AS DOUBLE)) AS rs, max(n) AS n FROM ranked GROUP BY g),
ties AS (SELECT sum(CAST(t AS DOUBLE) * t - 1) AS c FROM ranked),
stat AS (SELECT max(n) AS n, (12.0 / (max(n) * (max(n) + 1.0)) * sum(rs * rs / m) - 3.0 * (max(n) + 1))
  / (1.0 - (SELECT c FROM ties) / (CAST(max(n) AS DOUBLE) ** 3 - max(n))) AS h FROM groups)
SELECT n, round(h, 6) AS h, 2 AS df, round(exp(-h / 2.0), 6) AS p FROM stat""")
def kruskal_wallis(t):
    return rounded(ranktests.kruskal_wallis(t.orders, "o_totalprice", "o_orderstatus", 3), "h", "p")


CUTOFFS = f"""WITH {SCORED}, counts AS (
  SELECT CAST(n_chars AS DOUBLE) AS cutoff, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg
  FROM scored GROUP BY 1),
outcome AS (
  SELECT cutoff, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         CAST(sum(pos) OVER () - sum(pos) OVER w AS BIGINT) AS fn,
         CAST(sum(neg) OVER () - sum(neg) OVER w AS BIGINT) AS tn
  FROM counts WINDOW w AS (ORDER BY cutoff DESC)),
curve AS (SELECT cutoff, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, tp / (tp + fn) - fp / (fp + tn) AS youden FROM outcome)"""


@query(f"""{CUTOFFS} SELECT cutoff, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(youden, 6) AS youden FROM curve""")
def roc_curve(t):
    return rounded(roc.roc_curve(scored(t), "n_chars", "quality"), "tpr", "fpr", "youden")


@query(f"""{CUTOFFS} SELECT cutoff, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(youden, 6) AS youden FROM curve
ORDER BY curve.youden DESC, cutoff LIMIT 1""")
def youden_point(t):
    curve = roc.roc_curve(scored(t), "n_chars", "quality")
    return rounded(roc.youden_point(curve), "tpr", "fpr", "youden")


@query(f"""{CUTOFFS} SELECT cutoff, round(youden, 6) AS ks FROM curve ORDER BY curve.youden DESC, cutoff LIMIT 1""")
def ks_stat(t):
    return rounded(roc.ks_stat(scored(t), "n_chars", "quality"), "ks")


@query(f"""{CUTOFFS} SELECT cutoff, round((tp + tn) / (tp + tn + fp + fn), 6) AS acc, round(tp / (tp + fn), 6) AS sens,
  round(tn / (tn + fp), 6) AS spec, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
  round(tp / (tp + fn) / nullif(fp / (fp + tn), 0), 6) AS pdlr FROM outcome""")
def cutoff_metrics(t):
    metrics = roc.cutoff_metrics(scored(t), "n_chars", "quality")
    return rounded(metrics, "acc", "sens", "spec", "ppv", "npv", "pdlr")


@query(f"""WITH {SCORED}, ranked AS (
  SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM scored),
s AS (SELECT count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic <> 1) AS n_neg,
  sum(CAST(r AS DOUBLE)) FILTER (toxic = 1) AS rs FROM ranked)
SELECT round(1.0 - (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc, n_pos, n_neg FROM s""")
def auc_empirical(t):
    area = roc.auc_empirical(scored(t), "n_chars", "toxic", higher_is_positive=False)
    return rounded(area, "auc")


@query(f"""WITH {SCORED}, p AS (SELECT row_number() OVER () AS i, n_chars AS x FROM scored WHERE quality = 1),
q AS (SELECT row_number() OVER () AS j, n_chars AS y FROM scored WHERE quality <> 1),
beats AS (SELECT i, j, CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END AS w FROM p CROSS JOIN q),
a AS (SELECT avg(w) AS v FROM beats GROUP BY i), b AS (SELECT avg(w) AS v FROM beats GROUP BY j),
s AS (SELECT (SELECT avg(v) FROM a) AS auc, sqrt((SELECT var_samp(v) / count(*) FROM a) + (SELECT var_samp(v) / count(*) FROM b)) AS se,
  (SELECT count(*) FROM a) AS n_pos, (SELECT count(*) FROM b) AS n_neg)
SELECT round(auc, 6) AS auc, round(se, 6) AS std_err, round(greatest(0.0, auc - {Z95} * se), 6) AS lower,
  round(least(1.0, auc + {Z95} * se), 6) AS upper, n_pos, n_neg FROM s""")
def auc_delong(t):
    return rounded(roc.auc_delong(scored(t), "n_chars", "quality"), "auc", "std_err", "lower", "upper")


@query(f"""WITH {SCORED}, facts AS (
  SELECT stddev_samp(n_chars) AS sd, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr, count(*) AS n,
    min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high FROM scored),
width AS (SELECT *, 0.9 * (CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd ELSE 1.0 END) * n ** -0.2 AS h FROM facts),
grid AS (SELECT h, low - 3.0 * h AS start, (high - low + 6.0 * h) / 511 AS step FROM width),
dealt AS (SELECT quality, (n_chars - start) / step AS u FROM scored CROSS JOIN grid),
bins AS (SELECT bin, sum(CASE WHEN quality = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN quality <> 1 THEN w ELSE 0 END) AS neg
  FROM (SELECT quality, floor(u) AS bin, 1.0 - (u - floor(u)) AS w FROM dealt UNION ALL
        SELECT quality, floor(u) + 1, u - floor(u) FROM dealt) GROUP BY bin),
density AS (SELECT p, max(start) AS start, max(step) AS step, sum(pos * exp(-0.5 * ((p - bin) * step / h) ** 2)) AS pos,
  sum(neg * exp(-0.5 * ((p - bin) * step / h) ** 2)) AS neg FROM bins CROSS JOIN grid CROSS JOIN range(512) r(p) GROUP BY p),
rates AS (SELECT p, start + p * step AS cutoff, sum(pos) OVER w / sum(pos) OVER () AS tpr, sum(neg) OVER w / sum(neg) OVER () AS fpr
  FROM density WINDOW w AS (ORDER BY p DESC)),
strips AS (SELECT *, (fpr - coalesce(lead(fpr) OVER w, 0)) * (tpr + coalesce(lead(tpr) OVER w, 0)) / 2 AS strip FROM rates WINDOW w AS (ORDER BY p))
SELECT round(cutoff, 4) AS cutoff, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(sum(strip) OVER (), 6) AS auc FROM strips""")
def roc_smooth(t):
    curve = rounded(roc.roc_smooth(scored(t), "n_chars", "quality"), "fpr", "tpr", "auc")
    return curve.withColumn("cutoff", F.round("cutoff", 4))


MODEL = f"""{SCORED}, moments AS (
  SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg,
    avg(n_chars) FILTER (quality = 1) AS m1, avg(n_chars) FILTER (quality <> 1) AS m0,
    stddev_samp(n_chars) FILTER (quality = 1) AS s1, stddev_samp(n_chars) FILTER (quality <> 1) AS s0 FROM scored),
coef AS (SELECT *, (m1 - m0) / s1 AS a, s0 / s1 AS b FROM moments),
model AS (SELECT *, {normal_cdf_sql("a / sqrt(1.0 + b * b)")} AS auc FROM coef)"""


def quantile_sql(p: str) -> str:
    def poly(x, coefficients):
        out = f"({coefficients[0]!r}::DOUBLE)"
        for a in coefficients[1:]:
            out = f"({out} * {x} + ({a!r}::DOUBLE))"
        return out

    def tail(x):
        r = f"sqrt(-2.0 * ln({x}))"
        return f"{poly(r, tails.QUANTILE_TAIL_UPPER)} / {poly(r, tails.QUANTILE_TAIL_LOWER)}"

    q = f"({p} - 0.5)"
    centre = (
        f"{q} * {poly(f'({q} * {q})', tails.QUANTILE_CENTRE_UPPER)}"
        f" / {poly(f'({q} * {q})', tails.QUANTILE_CENTRE_LOWER)}"
    )
    return (
        f"(CASE WHEN {p} < {QUANTILE_TAIL_START} THEN {tail(p)}"
        f" WHEN {p} > 1 - {QUANTILE_TAIL_START} THEN -({tail(f'(1.0 - {p})')}) ELSE {centre} END)"
    )


GRID = f"""{MODEL}, grid AS (SELECT i / 100.0::DOUBLE AS fpr FROM range(1, 100) t(i)),
quantiles AS (SELECT fpr, {quantile_sql("fpr")} AS z, {quantile_sql("(1.0 - fpr)")} AS zc FROM grid),
smooth AS (SELECT fpr, zc, {normal_cdf_sql("a + b * z")} AS tpr, auc, m0, s0, n_pos FROM quantiles CROSS JOIN model)"""


@query(f"""WITH {GRID} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(auc, 6) AS auc FROM smooth""")
def roc_binormal(t):
    return rounded(roc.roc_binormal(scored(t), "n_chars", "quality"), "fpr", "tpr", "auc")


@query(f"""WITH {GRID}, band AS (SELECT fpr, tpr, {Z95} * sqrt(tpr * (1.0 - tpr) / n_pos) AS half FROM smooth)
SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(greatest(0.0, tpr - half), 6) AS lower,
  round(least(1.0, tpr + half), 6) AS upper FROM band""")
def roc_ci(t):
    return rounded(roc.roc_ci(scored(t), "n_chars", "quality"), "fpr", "tpr", "lower", "upper")


@query(f"""WITH {GRID} SELECT round(tpr - fpr, 6) AS ks, round(m0 + s0 * zc, 4) AS cutoff FROM smooth
ORDER BY smooth.tpr - smooth.fpr DESC LIMIT 1""")
def ks_binormal(t):
    gap = rounded(roc.ks_stat(scored(t), "n_chars", "quality", method="binormal"), "ks")
    return gap.withColumn("cutoff", F.round("cutoff", 4))


@query(f"""WITH {MODEL}, parts AS (SELECT auc, n_pos, n_neg, sqrt((auc * (1.0 - auc)
    + (n_pos - 1) * (auc / (2.0 - auc) - auc * auc) + (n_neg - 1) * (2.0 * auc * auc / (1.0 + auc) - auc * auc))
    / (n_pos * n_neg)) AS se FROM model)
SELECT round(auc, 6) AS auc, round(se, 6) AS std_err, round(greatest(0.0, auc - {Z95} * se), 6) AS lower,
  round(least(1.0, auc + {Z95} * se), 6) AS upper, n_pos, n_neg FROM parts""")
def auc_ci(t):
    model = roc.class_moments(scored(t), "n_chars", "quality")
    return rounded(roc.auc_ci(model), "auc", "std_err", "lower", "upper")


@query(f"""SELECT event_id, round({erfc_sql("value / 10.0")}, 6) AS erfc, round({normal_cdf_sql("value / 10.0")}, 6) AS cdf,
  round(exp(-value / 2.0), 6) AS chi2_two FROM events""")
def tail_functions(t):
    return t.events.select(
        "event_id",
        F.round(tails.erfc(F.col("value") / 10.0), 6).alias("erfc"),
        F.round(tails.normal_cdf(F.col("value") / 10.0), 6).alias("cdf"),
        F.round(tails.chi_square_tail("value", 2), 6).alias("chi2_two"),
    )
