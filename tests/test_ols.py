"""Regression against numpy, Spark ML and textbook quantiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from clustrial.functions.tails import f_upper, t_quantile, t_two_sided
from clustrial.operators import factors as factors_module
from clustrial.operators.factors import factors, triangle
from clustrial.operators.ols import fit_ols


def _data(n=60, groups=1, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "id": [f"{i:05d}" for i in rng.permutation(n)],
            "g": np.where(rng.random(n) < 0.6, 0, rng.integers(0, groups, n)),
            "x1": rng.normal(200, 30, n),
            "x2": rng.integers(0, 2, n).astype(float),
            "x3": rng.normal(0, 1, n),
        }
    )
    pdf["y"] = 3 + 0.8 * pdf.x1 - 5 * pdf.x2 + pdf.x3 + rng.gamma(2, 4, n)
    return pdf


def _expected(pdf, x):
    """The whole summary from the design matrix, rows in order of id."""
    pdf = pdf.sort_values("id")
    design = np.column_stack([np.ones(len(pdf)), pdf[x]])
    n, k = len(pdf), len(x)
    beta, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    e = pdf.y.to_numpy() - design @ beta
    sse, sst = e @ e, ((pdf.y - pdf.y.mean()) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse / (n - k - 1))
    m2, m3, m4 = (np.mean((e - e.mean()) ** p) for p in (2, 3, 4))
    values = np.linalg.eigvalsh(design.T @ design)
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1)
    return beta, se, {
        "n": n, "df_model": k, "df_resid": n - k - 1, "r2": 1 - sse / sst,
        "adj_r2": 1 - (sse / (n - k - 1)) / (sst / (n - 1)),
        "f": ((sst - sse) / k) / (sse / (n - k - 1)), "llf": llf,
        "aic": -2 * llf + 2 * (k + 1), "bic": -2 * llf + (k + 1) * math.log(n),
        "skew": m3 / m2**1.5, "kurtosis": m4 / m2**2,
        "jb": n / 6 * ((m3 / m2**1.5) ** 2 + (m4 / m2**2 - 3) ** 2 / 4),
        "durbin_watson": (np.diff(e) ** 2).sum() / sse,
        "cond_no": math.sqrt(values[-1] / values[0]),
    }


def _check(coefficients, model, pdf, x):
    beta, se, stats = _expected(pdf, x)
    by_term = coefficients.set_index("term").loc[["Intercept", *x]]
    np.testing.assert_allclose(by_term["coef"], beta, rtol=1e-8)
    np.testing.assert_allclose(by_term["std_err"], se, rtol=1e-8)
    np.testing.assert_allclose(by_term["t"], beta / se, rtol=1e-8)
    reach = t_quantile(0.95, np.array([float(stats["df_resid"])]))[0] * se
    np.testing.assert_allclose(by_term["ci_low"], beta - reach, rtol=1e-7)
    np.testing.assert_allclose(by_term["ci_high"], beta + reach, rtol=1e-7)
    for name, value in stats.items():
        assert model[name] == pytest.approx(value, rel=1e-6), name


@pytest.mark.parametrize("x", [["x1"], ["x1", "x2"], ["x1", "x2", "x3"]])
def test_summary_equals_the_design_matrix(spark, sliced, x):
    pdf = _data()
    df = spark.createDataFrame(pdf).repartition(3)
    fit = fit_ols(df, "y", x, order_by=["id"])
    _check(fit.coefficients.toPandas(), fit.model.first().asDict(), pdf, x)


def test_groups_are_fitted_apart(spark, sliced):
    pdf = _data(400, groups=4)
    fit = fit_ols(spark.createDataFrame(pdf), "y", ["x1", "x2"], by=["g"], order_by=["id"])
    coefficients, model = fit.coefficients.toPandas(), fit.model.toPandas().set_index("g")
    assert len(model) == 4
    for group, part in pdf.groupby("g"):
        _check(coefficients[coefficients.g == group], model.loc[group], part, ["x1", "x2"])


def test_row_order_does_not_matter(spark):
    pdf = _data()
    a, b = (
        fit_ols(spark.createDataFrame(p), "y", ["x1", "x2"], order_by=["id"]).model.first()
        for p in (pdf, pdf.sample(frac=1, random_state=1))
    )
    assert a.r2 == pytest.approx(b.r2, rel=1e-10)
    assert a.durbin_watson == pytest.approx(b.durbin_watson, rel=1e-10)


def test_without_an_order_there_is_no_durbin_watson(spark):
    fit = fit_ols(spark.createDataFrame(_data()), "y", ["x1"])
    assert fit.model.first().durbin_watson is None


def test_same_as_spark_ml(spark):
    pdf = _data(200)
    df = spark.createDataFrame(pdf)
    features = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(df)
    ml = LinearRegression(labelCol="y", solver="normal").fit(features).summary
    got = fit_ols(df, "y", ["x1", "x2", "x3"]).coefficients.toPandas().set_index("term")
    terms = ["x1", "x2", "x3", "Intercept"]
    np.testing.assert_allclose(got.loc[terms, "std_err"], ml.coefficientStandardErrors, rtol=1e-7)
    np.testing.assert_allclose(got.loc[terms, "t"], ml.tValues, rtol=1e-7)
    np.testing.assert_allclose(got.loc[terms, "p_value"], ml.pValues, rtol=1e-5, atol=1e-12)


def test_rows_with_nulls_are_left_out(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    holes = df.unionByName(
        spark.sql("SELECT 'z' id, 0L g, CAST(NULL AS DOUBLE) x1, 1D x2, 0D x3, 5D y")
    ).unionByName(spark.sql("SELECT 'y' id, 0L g, 1D x1, 1D x2, 0D x3, CAST(NULL AS DOUBLE) y"))
    fit = fit_ols(holes, "y", ["x1", "x2"], order_by=["id"])
    _check(fit.coefficients.toPandas(), fit.model.first().asDict(), pdf, ["x1", "x2"])


@pytest.mark.parametrize(
    "data",
    [
        [(1.0, 2.0, 4.0), (2.0, 3.0, 6.0), (3.0, 5.0, 10.0), (4.5, 7.0, 14.0)],  # collinear
        [(1.0, 2.0, 3.0), (2.0, 3.0, 3.0), (3.0, 5.0, 3.0), (4.5, 7.0, 3.0)],  # constant
        [(1.0, 2.0, 4.0), (2.0, 3.0, 5.0)],  # fewer rows than coefficients
        [],
    ],
)
def test_no_coefficients_where_there_is_no_unique_fit(spark, data):
    df = spark.createDataFrame([(str(i), *row) for i, row in enumerate(data)], "id STRING, y DOUBLE, a DOUBLE, b DOUBLE")
    fit = fit_ols(df, "y", ["a", "b"], order_by=["id"])
    assert [r.term for r in fit.coefficients.collect()] == ["Intercept", "a", "b"]
    assert {r.coef for r in fit.coefficients.collect()} == {None}
    assert {r.p_value for r in fit.coefficients.collect()} == {None}
    assert fit.model.first().r2 is None


def test_no_degrees_of_freedom_left(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 3.0)], "id STRING, y DOUBLE, x DOUBLE")
    fit = fit_ols(df, "y", ["x"], order_by=["id"])
    assert [r.coef for r in fit.coefficients.collect()] == pytest.approx([0.5, 0.5])
    assert {r.std_err for r in fit.coefficients.collect()} == {None}
    assert fit.model.first().f is None


def test_an_exact_line(spark):
    data = [(str(i), 2.0 + 3.0 * i, float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "id STRING, y DOUBLE, x DOUBLE")
    fit = fit_ols(df, "y", ["x"], order_by=["id"])
    assert [r.coef for r in fit.coefficients.collect()] == pytest.approx([2.0, 3.0])
    assert fit.model.first().r2 == pytest.approx(1.0)


def test_normality_score_of_normal_residuals_is_small(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"x": rng.normal(size=2000)})
    pdf["y"] = pdf.x + rng.normal(size=2000)
    model = fit_ols(spark.createDataFrame(pdf), "y", ["x"]).model.first()
    assert 0 < model.omnibus < 12 and 0 < model.omnibus_p < 1
    pdf["y"] = pdf.x + rng.exponential(size=2000)
    assert fit_ols(spark.createDataFrame(pdf), "y", ["x"]).model.first().omnibus_p < 1e-6


def test_tails_equal_textbook_values():
    df = np.array([1.0, 4.0, 10.0, 37.0, 120.0])
    critical = [12.7062, 2.77645, 2.22814, 2.02619, 1.97993]
    np.testing.assert_allclose(t_quantile(0.95, df), critical, rtol=1e-5)
    np.testing.assert_allclose(t_two_sided(np.array(critical), df), 0.05, rtol=1e-4)
    # The 95 % points of F(2, 10), F(3, 36) and F(1, 4).
    f = f_upper(np.array([4.10282, 2.86627, 7.70865]), np.array([2, 3, 1]), np.array([10, 36, 4]))
    np.testing.assert_allclose(f, 0.05, rtol=1e-4)
    # With two numerator degrees of freedom the tail has a closed form.
    np.testing.assert_allclose(f_upper(1.7, 2, 37), (1 + 2 * 1.7 / 37) ** (-37 / 2), rtol=1e-12)
    assert f_upper(0.0, 2, 37) == 1.0 and t_two_sided(np.array([0.0]), np.array([5.0]))[0] == 1.0


@pytest.mark.parametrize("name", ["e", "n", "y", "coef", "place", "x0", "step", "means", "_slice"])
def test_group_columns_may_have_any_name(spark, name):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 5, 6, 7, 9], "b": [2.0, 1, 4, 3, 7, 8, 1, 5], "g": [1, 1, 1, 1, 2, 2, 2, 2]})
    want = fit_ols(spark.createDataFrame(pdf), "a", ["b"], by=["g"], order_by=["b"])
    fit = fit_ols(spark.createDataFrame(pdf.rename(columns={"g": name})), "a", ["b"], by=[name], order_by=["b"])
    for got, expected in ((fit.coefficients, want.coefficients), (fit.model, want.model)):
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in expected.collect())))
        assert got.columns[0] == name


def test_nan_rows_are_left_out(spark):
    rows_ = [(float(k), float(k * k)) for k in range(9)]
    clean = fit_ols(spark.createDataFrame(rows_, "x double, y double"), "y", ["x"]).coefficients.collect()
    dirty = [*rows_, (float("nan"), 1.0), (1.0, float("nan")), (None, 2.0)]
    got = fit_ols(spark.createDataFrame(dirty, "x double, y double"), "y", ["x"]).coefficients.collect()
    assert [tuple(r)[1:] for r in got] == [pytest.approx(tuple(r)[1:]) for r in clean]


@pytest.mark.parametrize("order_by", [[], ["id"]])
def test_factors_give_the_same_summary(spark, sliced, monkeypatch, order_by):
    monkeypatch.setattr(factors_module, "FAN_IN", 2)
    pdf = _data(400, groups=4)
    df = spark.createDataFrame(pdf).repartition(7)
    fit = fit_ols(df, "y", ["x1", "x2"], by=["g"], order_by=order_by, solver="qr")
    coefficients, model = fit.coefficients.toPandas(), fit.model.toPandas().set_index("g")
    for group, part in pdf.groupby("g"):
        line = model.loc[group].to_dict()
        if not order_by:
            assert math.isnan(line["durbin_watson"])
            line["durbin_watson"] = _expected(part, ["x1", "x2"])[2]["durbin_watson"]
        _check(coefficients[coefficients.g == group], line, part, ["x1", "x2"])
    whole = fit_ols(df, "y", ["x1", "x2"], order_by=["id"], solver="qr")
    _check(whole.coefficients.toPandas(), whole.model.first().asDict(), pdf, ["x1", "x2"])


def test_nearly_collinear_predictors_are_told_apart_by_factors(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"far": rng.integers(1, 2000, 3000) * 65536.0, "q": rng.integers(1, 50, 3000).astype(float)})
    pdf["near"], pdf["y"] = pdf.far + pdf.q, 5 + 2 * pdf.q + rng.normal(size=3000)
    apart, *_ = np.linalg.lstsq(np.column_stack([np.ones(3000), pdf.far, pdf.q]), pdf.y, rcond=None)
    df = spark.createDataFrame(pdf).repartition(5)
    assert {r.coef for r in fit_ols(df, "y", ["far", "near"]).coefficients.collect()} == {None}
    got = [r.coef for r in fit_ols(df, "y", ["far", "near"], solver="qr").coefficients.collect()]
    assert got == pytest.approx([apart[0], apart[1] - apart[2], apart[2]], rel=1e-6)


@pytest.mark.parametrize("data", [[], [("a", 1.0, 2.0, 4.0)], [(str(i), 1.0 * i * i, 1.0 * i, 2.0 * i) for i in range(9)], [("a", 2.0, 3.0, 3.0)] * 5])
def test_factors_without_a_unique_fit(spark, data):
    df = spark.createDataFrame(data, "id STRING, y DOUBLE, a DOUBLE, b DOUBLE")
    for order_by in ([], ["id"]):
        fit = fit_ols(df, "y", ["a", "b"], order_by=order_by, solver="qr")
        assert {r.coef for r in fit.coefficients.collect()} == {None}
        assert fit.model.first().n == len(data)
    assert fit_ols(df, "y", ["a"], by=["id"], order_by=["b"], solver="qr").coefficients.count() == 2 * len({r[0] for r in data})


def test_factors_of_many_small_groups_and_one_large(spark, monkeypatch):
    """Handing on early and merging in several rounds lose no row, step or seam."""
    monkeypatch.setattr(factors_module, "FAN_IN", 2)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 900, 3000)), "i": np.arange(3000)})
    pdf["a"], pdf["b"] = rng.normal(size=3000), rng.normal(size=3000)
    by_order = spark.createDataFrame(pdf).repartitionByRange(6, "g", "i").sortWithinPartitions("g", "i")
    found = factors(by_order, ["a", "b"], ["g"], ordered=True).toPandas().set_index("g")
    assert len(found) == pdf.g.nunique() and found.n.sum() == 3000
    for group, part in pdf.sort_values("i").groupby("g"):
        values = part[["a", "b"]].to_numpy()
        for name, rows_ in (("rows", np.column_stack([np.ones(len(values)), values])), ("steps", np.diff(values, axis=0))):
            if not len(rows_):
                assert found.loc[group, name] is None
                continue
            r = np.reshape(found.loc[group, name], (rows_.shape[1], -1))
            np.testing.assert_allclose(r.T @ r, rows_.T @ rows_, atol=1e-9)


def test_a_task_hands_on_early_without_losing_steps(monkeypatch):
    monkeypatch.setattr(factors_module, "HELD", 1)
    monkeypatch.setattr(factors_module.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    frame = pd.DataFrame({"g": [1, 1, 2, 3, 3, 3, 3, 4], "a": [1.0, 4, 2, 9, 7, 1, 2, 5]})
    out = pd.concat(factors_module._task_factors(iter([frame[:5], frame[5:]]), ["g"], ["a"], True, True))
    assert out["g"].tolist() == [1, 2, 3, 4] and out["n"].tolist() == [2, 1, 4, 1]
    steps = {g: None if s is None else s[0] ** 2 for g, s in zip(out["g"], out["steps"])}
    assert steps[3] == pytest.approx(4 + 36 + 1) and steps[2] is None
    assert abs(triangle(np.array([[3.0], [4.0]]))[0, 0]) == pytest.approx(5)
