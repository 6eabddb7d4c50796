"""Proportional hazards regression on categorical covariates.

Subjects are aggregated once to risk sets: deaths and endings per time and observed pattern of covariate levels, one row
per range of time. The counts do not depend on the coefficients, so every Newton step is one pass over that durable
table (a few sums of Arrow batches), and the driver only solves a k×k system.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.operators.risksets import long_risk_sets, observed_patterns, pattern_levels, pattern_number, summed
from cohortline.operators.survival import level_values

#: Terms of a model, by default: the driver solves a system of as many equations.
MAX_TERMS = 4096
SHIFT = 16
#: A coefficient beyond this means that a level separates events from survivors: it is infinite.
INFINITE = 25.0
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("coef", T.DoubleType()),
        T.StructField("hazard_ratio", T.DoubleType()),
        T.StructField("std_err", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("p", T.DoubleType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("events", T.LongType()),
        T.StructField("iterations", T.IntegerType()),
        T.StructField("converged", T.BooleanType()),
    ]
)


def _shifted(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two ends x - d and x, moved up to where the asymptotic series below are accurate."""
    return x - d + SHIFT, x + SHIFT


def _gamma_steps(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """psi(x) - psi(x-d), psi'(x-d) - psi'(x) and log Gamma(x) - log Gamma(x-d), for x - d > 0.

    Written as differences throughout, so nothing cancels when x is huge against d.
    """
    low, high = _shifted(x, d)
    shrink = np.log1p(-d / high)

    def powers(e: int) -> np.ndarray:
        return low**-e - high**-e

    first = -shrink + d / (2 * low * high) + powers(2) / 12 - powers(4) / 120 + powers(6) / 252
    second = (
        d / (low * high) + d * (low + high) / (2 * (low * high) ** 2)
        + powers(3) / 6 - powers(5) / 30 + powers(7) / 42
    )
    logs = (
        d * np.log(high) - d - (low - 0.5) * shrink
        - powers(1) / 12 + powers(3) / 360 - powers(5) / 1260
    )
    for i in range(SHIFT):
        below, above = x - d + i, x + i
        first = first + d / (below * above)
        second = second + d * (below + above) / (below * above) ** 2
        logs = logs + np.log1p(-d / above)
    return first, second, logs


def tie_sums(
    risk: np.ndarray, dying: np.ndarray, deaths: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over l = 0 … d-1 of 1/r_l, 1/r_l² and log r_l, with r_l = risk - l/d * dying.

    By gamma functions, so a time at which millions die costs no more than one at which two do.
    """
    step = dying / deaths
    g1, g2, g3 = _gamma_steps(risk / step + 1, deaths)
    return g1 / step, g2 / step**2, deaths * np.log(step) + g3


def _contributions(
    d: np.ndarray, n: np.ndarray, design: np.ndarray, beta: np.ndarray, ties: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What some event times add to log likelihood, score and information.

    Second moments are never written out per time: what their sum needs of a pattern is one number.
    """
    weight = np.exp(design @ beta)
    deaths = d.sum(axis=1)
    risk, dying = n @ weight, d @ weight
    a1, b1 = (n * weight) @ design, (d * weight) @ design
    if ties == "breslow":
        logs = deaths * np.log(risk)
        expected = (deaths / risk) @ a1
        spread = weight * ((deaths / risk) @ n)
        product = a1.T @ (a1 * (deaths / risk**2)[:, None])
    else:
        h1, h2, logs = tie_sums(risk, dying, deaths)
        # (a - l/d b) / (A - l/d B) is the constant b/B plus a multiple of 1 / (A - l/d B)
        c1 = b1 / dying[:, None]
        r1 = a1 - risk[:, None] * c1
        expected = deaths @ c1 + h1 @ r1
        spread = weight * (h1 @ n + ((deaths - risk * h1) / dying) @ d)
        mixed = c1.T @ (r1 * h1[:, None])
        product = c1.T @ (c1 * deaths[:, None]) + mixed + mixed.T + r1.T @ (r1 * h2[:, None])
    loglik = (d @ (design @ beta) - logs).sum()
    return loglik, d.sum(axis=0) @ design - expected, design.T @ (design * spread[:, None]) - product


def _newton_sums(
    sets: DataFrame, patterns: np.ndarray, design: np.ndarray, beta: np.ndarray, ties: str
) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information at ``beta``, added up over the ranges of the risk sets."""
    k = design.shape[1]

    def partial(d: np.ndarray, n: np.ndarray, known: np.ndarray):
        return _contributions(d, n, design[np.searchsorted(patterns, known)], beta, ties)

    loglik, score, information = summed(sets, partial, [(), (k,), (k, k)])
    return float(loglik), score, information


def independent_terms(information: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Terms that those before them do not determine, by elimination in the order of the terms."""
    left, kept = information.copy(), []
    scale = np.diag(information).copy()
    for i in range(len(left)):
        if left[i, i] > tolerance * max(scale[i], 1e-300):
            kept.append(i)
            left -= np.outer(left[:, i], left[i]) / left[i, i]
    return kept


def cox_ph(
    df: DataFrame,
    time: str,
    event: str,
    covariates: Sequence[str],
    reference: Mapping[str, object] | None = None,
    levels: Mapping[str, Sequence] | None = None,
    ties: str = "efron",
    conf: float = 0.95,
    max_steps: int = 20,
    tolerance: float = 1e-9,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """One row per non-reference covariate level: coefficient, hazard ratio, interval, p.

    Runs when called. ``reference`` names the level each covariate is compared with (the first by default). Rows with a
    missing value are left out; levels that are not listed raise. A term that the terms before it determine has
    no coefficient (null), the others are fitted. Steps that lower the likelihood are halved; if ten halvings don't
    help, that raises. ``converged`` is false after ``max_steps`` and where a level separates events from survivors;
    such a coefficient is infinite. ``max_terms`` bounds the system that the driver solves; only patterns of levels that occur
    are counted, whatever the number of possible ones.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be 'efron' or 'breslow'")
    complete = df.dropna(subset=[time, event, *covariates])
    ordered: dict[str, list] = {}
    for c in covariates:
        values = list((levels or {}).get(c) or level_values(complete, c, max_terms + 1))
        base = (reference or {}).get(c, values[0])
        ordered[c] = [base, *[v for v in values if v != base]]
    terms = [(c, v) for c in covariates for v in ordered[c][1:]]
    if len(terms) > max_terms:
        raise ValueError(f"more than {max_terms} terms")
    if math.prod(map(len, ordered.values())) >= 2**63:
        raise ValueError("the possible patterns can't be numbered")
    sets = long_risk_sets(complete, time, event, pattern_number(ordered))
    each = F.inline(F.arrays_zip("pattern", "d", "n"))
    size = sets.select(each).agg(F.sum("n"), F.sum("d"), F.sum(F.when(F.col("pattern").isNull(), F.col("n")))).first()
    if size[2]:
        raise ValueError(f"{size[2]} rows have a level that is not listed")
    patterns = np.array(observed_patterns(sets), np.int64)
    first = {c: sum(len(ordered[x]) - 1 for x in covariates[:i]) for i, c in enumerate(covariates)}
    full = np.zeros((len(patterns), len(terms)))
    for row, number in enumerate(patterns.tolist()):
        for c, level in pattern_levels(number, ordered).items():
            if level:
                full[row, first[c] + level - 1] = 1.0

    kept = independent_terms(_newton_sums(sets, patterns, full, np.zeros(len(terms)), ties)[2]) if size[1] else []
    design = full[:, kept]
    beta, steps, converged, infinite = np.zeros(len(kept)), 0, not kept, np.zeros(len(kept), bool)
    if kept:
        loglik, score, information = _newton_sums(sets, patterns, design, beta, ties)
    while kept and steps < max_steps and not converged and not infinite.any():
        steps += 1
        move = np.linalg.pinv(information) @ score
        for _ in range(11):
            candidate = beta + move
            trial = _newton_sums(sets, patterns, design, candidate, ties)
            if trial[0] >= loglik - 1e-12 * abs(loglik):
                break
            move = move / 2
        else:
            raise ArithmeticError("no step raises the likelihood")
        gain, beta = abs(trial[0] - loglik), candidate
        loglik, score, information = trial
        infinite = np.abs(beta) > INFINITE
        converged = gain <= tolerance * (abs(loglik) + tolerance) and np.max(np.abs(move)) < 1e-7
    # a likelihood that still rises towards an infinite coefficient is flat: its information vanishes
    std_err = np.sqrt(np.maximum(np.diag(np.linalg.pinv(information)), 0)) if kept else np.zeros(0)
    flat = infinite | (np.abs(beta) > 10) & (std_err > 50) if kept else infinite
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    rows = []
    for i, (c, v) in enumerate(terms):
        values = [None] * 7
        if i in kept:
            at = kept.index(i)
            b, s = float(beta[at]), float(std_err[at])
            if flat[at]:
                b = math.copysign(math.inf, b)
                values = [b, math.exp(b), None, None, None, None, None]
            elif s > 0:
                values = [b, math.exp(b), s, b / s, math.erfc(abs(b / s) / math.sqrt(2)), math.exp(b - z * s), math.exp(b + z * s)]
            else:
                values = [b, math.exp(b), None, None, None, None, None]
        rows.append((c, str(v), *values, int(size[0] or 0), int(size[1] or 0), steps, bool(converged and not flat.any())))
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)
