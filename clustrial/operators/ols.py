"""Ordinary least squares with full inference, from distributed moments or triangular factors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrial.functions import has_keys, nan_as_missing, quoted
from clustrial.functions.tails import f_upper, t_quantile, t_two_sided
from clustrial.operators.factors import factors, triangle
from clustrial.sources.tables import in_slices, store


@dataclass(frozen=True)
class OlsFit:
    """A fit per group; the two result frames are planned when asked for."""

    fits: DataFrame
    x: Sequence[str]
    by: Sequence[str]  # under the names _GROUP + place in ``fits``
    confidence: float

    @cached_property
    def coefficients(self) -> DataFrame:
        """One row per term: estimate, standard error, t, p and confidence interval."""
        by, terms, confidence = self._keys, ["Intercept", *self.x], self.confidence
        return self._named(
            self.fits.mapInPandas(
                lambda batches: _term_rows(batches, by, terms, confidence),
                self._schema(TERM_FIELDS),
            )
        )

    @cached_property
    def model(self) -> DataFrame:
        """One row per model: fit, information criteria and residual tests."""
        by, k = self._keys, len(self.x)
        return self._named(
            self.fits.mapInPandas(
                lambda batches: _model_rows(batches, by, k), self._schema(MODEL_FIELDS)
            )
        )

    @property
    def _keys(self) -> list[str]:
        return _group_names(self.by)

    def _named(self, df: DataFrame) -> DataFrame:
        """Group columns under their own names; a result of the same name gets a ``_``."""
        results = [f"{c}_" if c in self.by else c for c in df.columns[len(self.by) :]]
        return df.toDF(*self.by, *results)

    def _schema(self, fields: str) -> str:
        kinds = dict(self.fits.dtypes)
        return ", ".join([*[f"`{name}` {kinds[name]}" for name in self._keys], fields])


def _group_names(by: Sequence[str]) -> list[str]:
    """Names for the group columns that no other column of a fit has."""
    return [f"_group_{i}" for i in range(len(by))]


def _moments(rows: DataFrame, variables: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count, means and covariances: central moments that merge stably across tasks."""
    means = ", ".join(f"avg({v})" for v in variables)
    covariances = ", ".join(
        f"covar_samp({a}, {b})" for a, b in combinations_with_replacement(variables, 2)
    )
    return rows.groupBy(*by).agg(
        F.expr("count(1) AS n"),
        F.expr(f"array({means}) AS means"),
        F.expr(f"array({covariances}) AS covariances"),
    )


def _solve(n: int, means: np.ndarray, packed: np.ndarray) -> tuple:
    """Coefficients, diagonal of (X'X)^-1, condition number and total sum of squares.

    The first variable is the response. Constant or collinear predictors, or fewer
    rows than coefficients, give no coefficients.
    """
    k = len(means) - 1
    empty = (None, None, None, None)
    if n < 2 or not np.all(np.isfinite(packed)):
        return empty
    cov = np.zeros((k + 1, k + 1))
    cov[np.triu_indices(k + 1)] = packed
    cov = cov + np.triu(cov, 1).T
    total = float(cov[0, 0] * (n - 1))

    sxx, sxy, x_mean = cov[1:, 1:], cov[1:, 0], means[1:]
    gram = np.empty((k + 1, k + 1))
    gram[0, 0], gram[0, 1:], gram[1:, 0] = n, n * x_mean, n * x_mean
    gram[1:, 1:] = (n - 1) * sxx + n * np.outer(x_mean, x_mean)
    # Singular values of X'X keep more of the small end than its eigenvalues do.
    singular = np.linalg.svd(gram, compute_uv=False)
    condition = float(np.sqrt(singular[0] / singular[-1])) if singular[-1] > 0 else None

    spread = np.sqrt(np.diag(sxx))
    if n < k + 1 or np.any(spread <= 1e-12 * np.maximum(np.abs(x_mean), 1e-300)):
        return None, None, condition, total
    correlation = sxx / np.outer(spread, spread)
    if np.linalg.eigvalsh(correlation)[0] < 1e-10:
        return None, None, condition, total
    inverse = np.linalg.inv(correlation) / np.outer(spread, spread)
    slopes = inverse @ sxy
    inverse = inverse / (n - 1)
    coef = np.concatenate([[means[0] - slopes @ x_mean], slopes])
    diagonal = np.concatenate([[1 / n + x_mean @ inverse @ x_mean], np.diag(inverse)])
    return coef.tolist(), diagonal.tolist(), condition, total


SOLVED_FIELDS = (
    "n BIGINT, coef ARRAY<DOUBLE>, diagonal ARRAY<DOUBLE>, cond_no DOUBLE, sst DOUBLE"
)


def _solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        solved = [
            _solve(int(n), np.array(means, dtype=float), np.array(packed, dtype=float))
            for n, means, packed in zip(batch["n"], batch["means"], batch["covariances"])
        ]
        out = batch.drop(columns=["means", "covariances"])
        for i, name in enumerate(("coef", "diagonal", "cond_no", "sst")):
            out[name] = pd.Series([s[i] for s in solved], index=batch.index, dtype=object)
        yield out


def _solve_factor(n: int, factor: np.ndarray) -> tuple:
    """As ``_solve``, from the triangle of a column of ones, the response and the predictors."""
    k = len(factor) - 2
    # The response goes last: then the predictors' own triangle stands in the upper left.
    r = triangle(factor[:, [0, *range(2, k + 2), 1]])
    own, total = r[: k + 1, : k + 1], float(r[1:, k + 1] @ r[1:, k + 1])
    singular = np.linalg.svd(own, compute_uv=False)
    condition = float(singular[0] / singular[-1]) if singular[-1] > 0 else None
    spread = np.linalg.norm(own[1:, 1:], axis=0)
    if n < k + 1 or np.any(spread <= 1e-12 * np.maximum(np.abs(own[0, 1:]), 1e-300)):
        return None, None, condition, total
    if np.linalg.svd(own[1:, 1:] / spread, compute_uv=False)[-1] < 1e-12:
        return None, None, condition, total
    inverse = np.linalg.inv(own)
    return (inverse @ r[: k + 1, k + 1]).tolist(), (inverse**2).sum(axis=1).tolist(), condition, total


def _solve_factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        solved = [
            (None, None, None, None) if rows is None else _solve_factor(int(n), np.reshape(rows, (round(len(rows) ** 0.5), -1)))
            for n, rows in zip(batch["n"], batch["rows"])
        ]
        out = batch.drop(columns=["rows", "steps"], errors="ignore")
        for i, name in enumerate(("coef", "diagonal", "cond_no", "sst")):
            out[name] = pd.Series([s[i] for s in solved], index=batch.index, dtype=object)
        yield out


def _residual_sums(
    rows: DataFrame, solved: DataFrame | dict[str, Column], y: str, x: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Power sums of the residuals, over rows in any order."""
    if by:
        rows = rows.join(solved.select(*by, "coef"), list(by))
    coef = [F.col("coef")[i] if by else solved["coef"][i] for i in range(len(x) + 1)]
    fitted = coef[0]
    for c, name in zip(coef[1:], x):
        fitted = fitted + c * F.col(name)
    rows = rows.withColumn("e", F.col(y) - fitted)
    return rows.groupBy(*by).agg(*[F.expr(f"sum({'*'.join('e' * p)}) AS e{p}") for p in range(1, 5)])


def _squared_steps(width: int) -> str:
    """The sum of squared steps between neighbouring residuals, a quadratic form of the coefficients.

    A step of the residuals is the step of the response less that of the fit, in which the
    intercept drops out; with the triangle of all steps it is the squared length of its
    product with (1, -slopes). Without coefficients it is null.
    """
    weights = ["1D", *[f"(-coef[{i}])" for i in range(1, width)]]
    lines = [" + ".join(f"steps[{i * width + j}] * {w}" for j, w in enumerate(weights)) for i in range(width)]
    return f"CASE WHEN steps IS NULL AND coef IS NOT NULL THEN 0D ELSE {' + '.join(f'pow({line}, 2)' for line in lines)} END"


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, missing where b is 0."""
    return np.divide(a, b, out=np.full(np.shape(b), np.nan), where=np.asarray(b) != 0)


def _skew_score(n: np.ndarray, skew: np.ndarray) -> np.ndarray:
    """Normal score of a sample skewness."""
    y = skew * np.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
    b = b / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = np.sqrt(2 * (b - 1)) - 1
    return np.arcsinh(y / np.sqrt(2 / (w2 - 1))) / np.sqrt(0.5 * np.log(w2))


def _kurtosis_score(n: np.ndarray, kurtosis: np.ndarray) -> np.ndarray:
    """Normal score of a sample kurtosis (3 for the normal distribution)."""
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - 3 * (n - 1) / (n + 1)) / np.sqrt(spread)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
    s = s * np.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + (8 / s) * (2 / s + np.sqrt(1 + 4 / (s * s)))
    d = 1 + x * np.sqrt(2 / (a - 4))
    root = np.sign(d) * _quotient(1 - 2 / a, np.abs(d)) ** (1 / 3)
    return (1 - 2 / (9 * a) - root) / np.sqrt(2 / (9 * a))


# The fields of the regression summary.
MODEL_FIELDS = (
    "n BIGINT, df_model INT, df_resid BIGINT, r2 DOUBLE, adj_r2 DOUBLE, f DOUBLE, "
    "f_pvalue DOUBLE, llf DOUBLE, aic DOUBLE, bic DOUBLE, omnibus DOUBLE, omnibus_p DOUBLE, "
    "skew DOUBLE, kurtosis DOUBLE, jb DOUBLE, jb_p DOUBLE, durbin_watson DOUBLE, cond_no DOUBLE"
)
TERM_FIELDS = (
    "term STRING, coef DOUBLE, std_err DOUBLE, t DOUBLE, p_value DOUBLE, "
    "ci_low DOUBLE, ci_high DOUBLE"
)


def _finite(columns: dict[str, np.ndarray], index: pd.Index) -> pd.DataFrame:
    frame = pd.DataFrame(columns, index=index)
    numbers = frame.select_dtypes("float").columns
    frame[numbers] = frame[numbers].where(np.isfinite(frame[numbers]))
    return frame


def _numbers(batch: pd.DataFrame) -> dict[str, np.ndarray]:
    """The one-row-per-group inputs as floats, with an exact fit's residuals set to 0."""
    kept = ("n", "sst", "e1", "e2", "e3", "e4", "steps", "cond_no")
    v = {name: pd.to_numeric(batch[name]).to_numpy(float) for name in kept}
    # A constant response, or residuals of rounding size, count as an exact fit.
    exact = (v["sst"] == 0) | (v["e2"] <= 1e-24 * v["sst"])
    v["sse"] = np.where(exact, 0.0, v["e2"])
    return v


def _model_rows(batches: Iterator[pd.DataFrame], by: Sequence[str], k: int):
    for batch in batches:
        v = _numbers(batch)
        n, sse, sst = v["n"], v["sse"], v["sst"]
        df = np.maximum(n - (k + 1), 0)
        with np.errstate(all="ignore"):
            r2 = 1 - _quotient(sse, sst)
            f = _quotient(r2 / k, _quotient(1 - r2, df))
            llf = np.where(sse > 0, -n / 2 * (math.log(2 * math.pi) + np.log(sse / n) + 1), np.nan)
            # Central moments from power sums; the mean residual is 0 up to rounding.
            m1, e2, e3 = v["e1"] / n, v["e2"], v["e3"]
            m2 = e2 / n - m1**2
            m3 = e3 / n - 3 * m1 * e2 / n + 2 * m1**3
            m4 = v["e4"] / n - 4 * m1 * e3 / n + 6 * m1**2 * e2 / n - 3 * m1**4
            skew, kurtosis = _quotient(m3, m2**1.5), _quotient(m4, m2**2)
            omnibus = _skew_score(n, skew) ** 2 + _kurtosis_score(n, kurtosis) ** 2
            omnibus = np.where(n >= 8, omnibus, np.nan)
            jb = n / 6 * (skew**2 + (kurtosis - 3) ** 2 / 4)
            tested = np.isfinite(f) & (df > 0)
            f_pvalue = np.full(len(n), np.nan)
            f_pvalue[tested] = f_upper(f[tested], float(k), df[tested])
            fields = {
                "r2": r2,
                "adj_r2": 1 - _quotient((1 - r2) * (n - 1), df),
                "f": f,
                "f_pvalue": f_pvalue,
                "llf": llf,
                "aic": -2 * llf + 2 * (k + 1),
                "bic": -2 * llf + (k + 1) * np.log(n),
                "omnibus": omnibus,
                "omnibus_p": np.exp(-omnibus / 2),
                "skew": skew,
                "kurtosis": kurtosis,
                "jb": jb,
                "jb_p": np.exp(-jb / 2),
                "durbin_watson": _quotient(v["steps"], e2),
                "cond_no": v["cond_no"],
            }
        out = _finite(fields, batch.index)
        out.insert(0, "n", batch["n"])
        out.insert(1, "df_model", k)
        out.insert(2, "df_resid", df.astype("int64"))
        yield pd.concat([batch[list(by)], out], axis=1)


def _term_rows(
    batches: Iterator[pd.DataFrame], by: Sequence[str], terms: Sequence[str], confidence: float
):
    blank = [np.nan] * len(terms)
    for batch in batches:
        v = _numbers(batch)
        df = np.maximum(v["n"] - len(terms), 0)
        usable = [c is not None for c in batch["coef"]]
        coef, diagonal = (
            np.array([c if ok else blank for c, ok in zip(batch[name], usable)], dtype=float)
            .reshape(len(batch), len(terms))
            for name in ("coef", "diagonal")
        )
        with np.errstate(all="ignore"):
            error = np.sqrt(_quotient(v["sse"], df)[:, None] * diagonal)
            t = _quotient(coef, error)
            df = np.repeat(df[:, None], len(terms), axis=1)
            tested = np.isfinite(t)
            p_value, critical = np.full(t.shape, np.nan), np.full(t.shape, np.nan)
            p_value[tested] = t_two_sided(t[tested], df[tested])
            critical[tested] = t_quantile(confidence, df[tested])
        fields = {
            "coef": coef,
            "std_err": error,
            "t": t,
            "p_value": p_value,
            "ci_low": coef - critical * error,
            "ci_high": coef + critical * error,
        }
        index = batch.index.repeat(len(terms))
        out = _finite({name: values.ravel() for name, values in fields.items()}, index)
        out.insert(0, "term", list(terms) * len(batch))
        yield pd.concat([batch[list(by)].loc[index], out], axis=1)


def fit_ols(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    by: Sequence[str] = (),
    order_by: Sequence[str] = (),
    confidence: float = 0.95,
    solver: str = "moments",
) -> OlsFit:
    """Fit ``y ~ 1 + x`` for each group of ``by``.

    Rows with a missing input or group (null or NaN) are left out; group and input columns
    may have any names. ``order_by`` names the row order the Durbin-Watson statistic refers
    to; without it that statistic is null. ``solver="moments"`` fits from means and
    covariances, one aggregation; ``"qr"`` from triangular factors merged in a tree, for
    predictors so nearly collinear that their products lose the difference (the limit is
    a relative distance of 1e-12 in place of 1e-5). A second aggregation sums powers of the
    residuals. ``df`` is worth storing first if it is long in the making.

    With ``order_by`` the narrow input is stored once and goes through one sorted pass,
    which keeps the triangle of the steps between neighbours for each task and group; the
    statistic then follows from the coefficients. A group holding a third of the rows is
    spread over many tasks.
    """
    if solver not in ("moments", "qr"):
        raise ValueError(f"no such solver: {solver}")
    variables = [y, *x]
    names = ["y", *[f"x{i}" for i in range(len(x))]]
    place = [F.col(quoted(c)).alias(f"p{i}") for i, c in enumerate([*order_by, *variables])]
    groups, by = by, _group_names(by)
    rows = df.select(
        *[F.col(quoted(c)).alias(name) for c, name in zip(groups, by)],
        *[F.expr(f"CAST({quoted(v)} AS DOUBLE) AS {name}") for v, name in zip(variables, names)],
        *([F.struct(*place).alias("place")] if order_by else []),
    )
    rows = nan_as_missing(rows, [*by, *names]).where(has_keys([*by, *names]))
    found = None
    if order_by:
        rows, sorted_rows = in_slices(rows, [*by, "place"], "ols")
        found = factors(sorted_rows, names, by, ordered=True, whole=solver == "qr")
        found = store(found, "ols-factors")
    elif solver == "qr":
        found = factors(rows, names, by)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{name}` {kinds[name]}" for name in by], SOLVED_FIELDS])
    if solver == "qr":
        solved = found.select(*by, "n", "rows").mapInPandas(_solve_factors, schema)
    else:
        solved = _moments(rows, names, by).mapInPandas(_solve_batches, schema)
    if by:
        solved = store(solved, "ols-solved")
        sums = _residual_sums(rows, solved, "y", names[1:], by)
        fits = solved.join(sums, list(by))
    else:
        # One group: its few numbers become constants of the next step.
        solved = _constants(solved)
        sums = _residual_sums(rows, solved, "y", names[1:], by)
        fits = sums.withColumns(solved)
    if not order_by:
        return OlsFit(fits.withColumn("steps", F.lit(None).cast("double")), x, groups, confidence)
    if by:
        fits = fits.join(found.select(*by, "steps"), list(by))
    else:
        steps = found.select("steps").first()
        fits = fits.withColumn("steps", F.lit(steps[0] if steps else None).cast("array<double>"))
    return OlsFit(fits.withColumn("steps", F.expr(_squared_steps(len(names)))), x, groups, confidence)


def _constants(solved: DataFrame) -> dict[str, Column]:
    """The only row of a frame, as constants of the frame's types; without a row, a fit of no rows."""
    found = solved.collect()
    row = found[0].asDict() if found else dict.fromkeys(solved.columns) | {"n": 0}

    def constant(value, kind: str) -> Column:
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value])
        return F.lit(value).cast(kind)

    return {name: constant(row[name], kind) for name, kind in solved.dtypes}
