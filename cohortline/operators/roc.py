"""How well a score separates two classes: empirical and binormal curves, AUC, KS, cutoff metrics.

Scores are compressed to counts per distinct value; curves come from running totals over those.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.tails import normal_cdf, normal_quantile
from cohortline.operators.ordered import quantile_columns, running_totals

GRID_STEPS = 100
SMOOTH_POINTS = 512
BANDWIDTH_RULE = (0.9, 1.34)  # fixed values of the rule of thumb for a normal kernel's width


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives ``pos`` and negatives ``neg`` per distinct score; incomplete rows are left out."""
    positive = F.col(label).cast("int") == 1
    return (
        df.dropna(subset=[score, label])
        .groupBy(F.col(score).cast("double").alias("cutoff"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def cutoff_counts(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True
) -> DataFrame:
    """Per cutoff the four outcome counts, calling a score at the cutoff or beyond it positive."""
    table = running_totals(score_counts(df, score, label), "cutoff", ["pos", "neg"])
    if higher_is_positive:
        tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
        fp = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    else:
        tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return table.select(
        "cutoff",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.col("total_neg") - fp).alias("tn"),
        (F.col("total_pos") - tp).alias("fn"),
        "pos",
        "neg",
    )


def _rate(part: str, *whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), sum(F.col(w) for w in whole).cast("double"))


def roc_curve(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True
) -> DataFrame:
    """Empirical curve: ``cutoff``, ``tpr``, ``fpr`` and ``youden`` = tpr - fpr."""
    counts = cutoff_counts(df, score, label, higher_is_positive)
    tpr, fpr = _rate("tp", "tp", "fn"), _rate("fp", "fp", "tn")
    return counts.select(
        "cutoff", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("youden")
    )


def youden_point(curve: DataFrame) -> DataFrame:
    """The curve's point furthest above the diagonal; the smallest such cutoff on a tie."""
    return curve.agg(F.max(F.struct("youden", -F.col("cutoff"), "tpr", "fpr")).alias("b")).select(
        (-F.col("b.col2")).alias("cutoff"), "b.tpr", "b.fpr", "b.youden"
    )


def auc_empirical(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True
) -> DataFrame:
    """Area under the empirical curve (tied scores count half), with the class sizes."""
    table = running_totals(score_counts(df, score, label), "cutoff", ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0
    area = F.try_divide(F.sum(F.col("pos").cast("double") * below), F.max("total_pos").cast("double") * F.max("total_neg").cast("double"))
    return table.agg(
        (area if higher_is_positive else 1.0 - area).alias("auc"),
        F.max("total_pos").alias("n_pos"),
        F.max("total_neg").alias("n_neg"),
    )


def auc_delong(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True, level: float = 0.95
) -> DataFrame:
    """Area under the empirical curve with the interval of DeLong, which supposes no distribution of the scores.

    A row's placement is the share of the other class that it is beyond, ties half; the area's variance is that of the
    positives' placements and of the negatives', each by its class size; without two rows of either there is none.
    Placements come from running counts.
    """
    table = running_totals(score_counts(df, score, label), "cutoff", ["pos", "neg"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    n_pos, n_neg = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    above = F.try_divide(F.col("cum_neg") - F.col("neg") / 2.0, n_neg)  # of a positive: negatives below it
    below = F.try_divide(F.col("total_pos") - F.col("cum_pos") + F.col("pos") / 2.0, n_pos)
    sums = table.agg(
        F.max("total_pos").alias("n_pos"),
        F.max("total_neg").alias("n_neg"),
        F.sum(pos * above).alias("a"),
        F.sum(pos * above * above).alias("aa"),
        F.sum(neg * below).alias("b"),
        F.sum(neg * below * below).alias("bb"),
    )

    def spread(total: str, square: str, n: str) -> Column:
        """Variance of the mean placement of a class of ``n``."""
        return F.try_divide(F.col(square) - F.col(total) * F.col(total) / F.col(n), F.col(n).cast("double") * (F.col(n) - 1))

    area = F.try_divide(F.col("a"), F.col("n_pos").cast("double"))
    variance = spread("a", "aa", "n_pos") + spread("b", "bb", "n_neg")
    z = NormalDist().inv_cdf(0.5 + level / 2)
    found = sums.select(
        (area if higher_is_positive else 1.0 - area).alias("auc"),
        F.sqrt(F.when(variance > 0, variance).when(variance.isNotNull(), 0.0)).alias("std_err"), "n_pos", "n_neg",
    )
    half = z * F.col("std_err")
    return found.select(
        "auc", "std_err",
        F.when(half.isNotNull(), F.greatest(F.lit(0.0), F.col("auc") - half)).alias("lower"),
        F.when(half.isNotNull(), F.least(F.lit(1.0), F.col("auc") + half)).alias("upper"),
        "n_pos", "n_neg",
    )


def roc_smooth(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True, points: int = SMOOTH_POINTS
) -> DataFrame:
    """Smooth curve without a model of the classes: rates above every cutoff of an even grid, after both classes were smoothed
    by a normal kernel, and the area under it.

    The kernel's width follows the spread of all scores, the lesser of standard deviation and quartile distance by
    BANDWIDTH_RULE; the grid goes three widths beyond them. Counts per score are dealt to the two grid points beside it, so that
    what is convolved has as many rows as the grid, whatever the number of scores.
    """
    counts = score_counts(df, score, label)
    both = counts.select(F.col("cutoff").alias("value"), (F.col("pos") + F.col("neg")).alias("n"))
    n, x = F.sum("n"), F.col("value")
    mean = F.sum(x * F.col("n")) / n
    facts = running_totals(both, "value", ["n"]).agg(
        *quantile_columns({"q1": 0.25, "q3": 0.75}), n.alias("rows"), mean.alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    centred = both.withColumn("mean", facts.select("mean").scalar())
    deviation = centred.agg(F.sqrt(F.sum((x - F.col("mean")) * (x - F.col("mean")) * F.col("n")) / (n - 1)).alias("sd"))
    narrow = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / BANDWIDTH_RULE[1])
    spread = F.when(narrow > 0, narrow).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    width = BANDWIDTH_RULE[0] * spread * F.pow("rows", F.lit(-0.2))
    grid = facts.withColumn("sd", deviation.scalar()).select(width.alias("h"), "low", "high").select(
        "h", (F.col("low") - 3.0 * F.col("h")).alias("start"),
        ((F.col("high") - F.col("low") + 6.0 * F.col("h")) / (points - 1)).alias("step"))
    known = grid.select(F.struct("*")).scalar()
    at = (F.col("cutoff") - F.col("start")) / F.col("step")
    part = F.col("at") - F.floor("at")
    sides = F.array(
        F.struct(F.floor("at").alias("bin"), (1.0 - part).alias("share")),
        F.struct((F.floor("at") + 1).alias("bin"), part.alias("share")),
    )
    dealt = counts.withColumn("grid", known).select("pos", "neg", "cutoff", "grid.*").withColumn("at", at).select("pos", "neg", F.inline(sides))
    bins = dealt.groupBy("bin").agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in ("pos", "neg")])
    # at most points times points rows
    apart = (F.col("point") - F.col("bin")) * F.col("step") / F.col("h")
    kernel = F.exp(-0.5 * apart * apart)
    near = bins.withColumn("grid", known).select("bin", "pos", "neg", "grid.*").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    density = near.groupBy("point", "start", "step").agg(*[F.sum(F.col(c) * kernel).alias(c) for c in ("pos", "neg")])
    whole = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # points rows
    ends = (Window.currentRow, Window.unboundedFollowing) if higher_is_positive else (Window.unboundedPreceding, Window.currentRow)
    beyond = Window.orderBy("point").rowsBetween(*ends)
    rates = density.select(
        "point", (F.col("start") + F.col("point") * F.col("step")).alias("cutoff"),
        *[F.try_divide(F.sum(c).over(beyond), F.sum(c).over(whole)).alias(name) for c, name in (("pos", "tpr"), ("neg", "fpr"))])
    order = Window.orderBy("point" if higher_is_positive else F.desc("point"))
    next_tpr, next_fpr = (F.coalesce(F.lead(c).over(order), F.lit(0.0)) for c in ("tpr", "fpr"))
    strips = rates.select("point", "cutoff", "tpr", "fpr", ((F.col("fpr") - next_fpr) * (F.col("tpr") + next_tpr) / 2.0).alias("strip"))
    return strips.select("cutoff", "fpr", "tpr", F.sum("strip").over(whole).alias("auc"))


def class_moments(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True
) -> DataFrame:
    """One row with the binormal model: a, b, AUC, class sizes, means and standard deviations."""
    sign = 1.0 if higher_is_positive else -1.0
    x = F.col(score).cast("double") * sign
    positive = F.col(label).cast("int") == 1
    up, down = F.when(positive, x), F.when(~positive, x)
    moments = df.dropna(subset=[score, label]).agg(
        F.count(up).alias("n_pos"),
        F.count(down).alias("n_neg"),
        F.avg(up).alias("mean_pos"),
        F.avg(down).alias("mean_neg"),
        F.stddev_samp(up).alias("sd_pos"),
        F.stddev_samp(down).alias("sd_neg"),
    )
    modelled = moments.withColumns(
        {
            "a": F.try_divide(F.col("mean_pos") - F.col("mean_neg"), F.col("sd_pos")),
            "b": F.try_divide(F.col("sd_neg"), F.col("sd_pos")),
        }
    )
    return modelled.withColumn(
        "auc", normal_cdf(F.col("a") / F.sqrt(1.0 + F.col("b") * F.col("b")))
    )


def _on_grid(model: DataFrame, steps: int) -> DataFrame:
    """The smooth curve at fpr = 1/steps … (steps-1)/steps."""
    grid = model.withColumn(
        "fpr", F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda i: i / float(steps)))
    )
    return grid.withColumn("tpr", normal_cdf(F.col("a") + F.col("b") * normal_quantile("fpr")))


def roc_binormal(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True, steps: int = GRID_STEPS
) -> DataFrame:
    """Smooth curve of two normal classes on an even false-positive grid, with its AUC."""
    model = class_moments(df, score, label, higher_is_positive)
    return _on_grid(model, steps).select("fpr", "tpr", "auc")


def auc_ci(model: DataFrame, level: float = 0.95) -> DataFrame:
    """AUC with its analytic standard error and interval, from a row with auc, n_pos, n_neg."""
    auc = F.col("auc")
    q1, q2 = auc / (2.0 - auc), 2.0 * auc * auc / (1.0 + auc)
    square = auc * auc
    variance = F.try_divide(
        auc * (1.0 - auc)
        + (F.col("n_pos") - 1) * (q1 - square)
        + (F.col("n_neg") - 1) * (q2 - square),
        F.col("n_pos").cast("double") * F.col("n_neg").cast("double"),
    )
    z = NormalDist().inv_cdf(0.5 + level / 2)
    return model.select("auc", F.sqrt(variance).alias("std_err"), "n_pos", "n_neg").select(
        "auc",
        "std_err",
        F.greatest(F.lit(0.0), auc - z * F.col("std_err")).alias("lower"),
        F.least(F.lit(1.0), auc + z * F.col("std_err")).alias("upper"),
        "n_pos",
        "n_neg",
    )


def roc_ci(
    df: DataFrame,
    score: str,
    label: str,
    level: float = 0.95,
    higher_is_positive: bool = True,
    steps: int = GRID_STEPS,
) -> DataFrame:
    """Pointwise band around the smooth curve, binomial in the number of positives."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    tpr = F.col("tpr")
    half = z * F.sqrt(F.try_divide(tpr * (1.0 - tpr), F.col("n_pos").cast("double")))
    return _on_grid(class_moments(df, score, label, higher_is_positive), steps).select(
        "fpr",
        "tpr",
        F.greatest(F.lit(0.0), tpr - half).alias("lower"),
        F.least(F.lit(1.0), tpr + half).alias("upper"),
    )


def ks_stat(
    df: DataFrame,
    score: str,
    label: str,
    higher_is_positive: bool = True,
    method: str = "empirical",
    steps: int = GRID_STEPS,
) -> DataFrame:
    """Largest gap between the class distributions and the cutoff where it is reached."""
    if method == "empirical":
        point = youden_point(roc_curve(df, score, label, higher_is_positive))
        return point.select(F.col("youden").alias("ks"), "cutoff")
    if method != "binormal":
        raise ValueError("method must be 'empirical' or 'binormal'")
    model = _on_grid(class_moments(df, score, label, higher_is_positive), steps)
    sign = 1.0 if higher_is_positive else -1.0
    cutoff = sign * (F.col("mean_neg") + F.col("sd_neg") * normal_quantile(1.0 - F.col("fpr")))
    return (
        model.select((F.col("tpr") - F.col("fpr")).alias("gap"), cutoff.alias("cutoff"))
        .agg(F.max("gap").alias("ks"), F.max_by("cutoff", "gap").alias("cutoff"))
    )


def cutoff_metrics(
    df: DataFrame, score: str, label: str, higher_is_positive: bool = True
) -> DataFrame:
    """Accuracy, sensitivity, specificity, predictive values and positive likelihood ratio at every
    cutoff; null where a denominator is zero."""
    counts = cutoff_counts(df, score, label, higher_is_positive)
    sens, spec = _rate("tp", "tp", "fn"), _rate("tn", "tn", "fp")
    right = (F.col("tp") + F.col("tn")).cast("double")
    everyone = (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).cast("double")
    return counts.select(
        "cutoff",
        F.try_divide(right, everyone).alias("acc"),
        sens.alias("sens"),
        spec.alias("spec"),
        _rate("tp", "tp", "fp").alias("ppv"),
        _rate("tn", "tn", "fn").alias("npv"),
        F.try_divide(sens, _rate("fp", "fp", "tn")).alias("pdlr"),
    )
