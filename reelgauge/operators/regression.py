"""Ordinary least squares with the usual summary."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.operators.factorise import LeastSquares, triangular_factor
from reelgauge.operators.ordering import successive_differences
from reelgauge.probability import chi_square_tail_2, f_tail, t_two_sided

INTERCEPT = "const"
# Above this condition number of XᵀX, the square of X's, the coefficients are not to be trusted.
COLLINEAR = 1e13


def cross_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, total) for the upper triangle of XᵀX, with a constant column."""
    terms = {INTERCEPT: F.lit(1.0)} | {name: F.col(name).cast("double") for name in columns}
    names = list(terms)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    complete = df.na.drop(subset=list(columns))
    one_row = complete.agg(*[
        F.sum(terms[x] * terms[y]).alias(f"p{i}") for i, (x, y) in enumerate(pairs)
    ])
    entries = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"p{i}").alias("total"))
        for i, (x, y) in enumerate(pairs)
    ]
    return one_row.select(F.inline(F.array(*entries)))


@dataclass
class OlsFit:
    """A fitted linear model and the rows it was fitted on.

    Collinear columns share their effect: of all solutions this is the one of least norm.
    """

    solution: LeastSquares
    label: str
    features: list[str]
    rows: DataFrame

    @property
    def terms(self) -> dict[str, float]:
        return dict(zip([INTERCEPT, *self.features], self.solution.values.tolist(), strict=True))

    @property
    def collinear(self) -> bool:
        return not self.solution.condition**2 < COLLINEAR

    def prediction(self) -> Column:
        """Fitted value as plain column arithmetic; NULL where a feature is."""
        terms = self.terms
        return sum(
            (F.lit(terms[name]) * F.col(name) for name in self.features), F.lit(terms[INTERCEPT])
        )

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.prediction())

    def coefficients(self) -> DataFrame:
        """(term, coefficient, std_error, t_value, p_value), intercept first."""
        freedom, errors = self.solution.freedom, self.solution.errors
        errors = [None] * len(self.terms) if errors is None else errors.tolist()
        table = []
        for (term, value), error in zip(self.terms.items(), errors, strict=True):
            t_value = value / error if error else None
            table.append((term, value, error, t_value, t_two_sided(t_value, float(freedom))))
        schema = "term string, coefficient double, std_error double, t_value double, p_value double"
        return self.rows.sparkSession.createDataFrame(table, schema)

    def summary(self, order_col: str | None = None) -> DataFrame:
        """One row of fit statistics; Durbin-Watson only with a row order."""
        y, residual = F.col(self.label), F.col("_residual")
        with_residual = self.predict(self.rows, "_fitted").withColumn(
            "_residual", y - F.col("_fitted")
        )
        moments = with_residual.agg(
            F.count("*").alias("n"),
            (F.var_pop(y) * F.count("*")).alias("tss"),
            *[F.sum(F.pow(residual, F.lit(p))).alias(f"m{p}") for p in (2, 3, 4)],
        ).first()
        n, rss, tss = moments.n, moments.m2 or 0.0, moments.tss
        # A collinear column explains nothing of its own.
        k = self.solution.rank - 1
        freedom = n - k - 1
        r2 = 1 - rss / tss if tss else None
        f_value = p_value = log_likelihood = skew = kurtosis = bera = None
        if r2 is not None and freedom > 0 and rss > 0 and k > 0:
            f_value = (tss - rss) / k / (rss / freedom)
            p_value = f_tail(f_value, k, freedom)
        if rss > 0:
            log_likelihood = -n / 2 * (math.log(2 * math.pi * rss / n) + 1)
            skew = moments.m3 / n / (rss / n) ** 1.5
            kurtosis = moments.m4 / n / (rss / n) ** 2
            bera = n / 6 * (skew**2 + (kurtosis - 3) ** 2 / 4)
        watson = None
        if order_col is not None and rss > 0:
            steps = successive_differences(with_residual, [], order_col, "_residual").first()
            watson = steps.square_sum / rss
        condition = self.solution.condition
        values = {
            "rows": n,
            "r2": r2,
            "adj_r2": 1 - (1 - r2) * (n - 1) / freedom if r2 is not None and freedom > 0 else None,
            "f_value": f_value,
            "f_p_value": p_value,
            "log_likelihood": log_likelihood,
            "aic": None if log_likelihood is None else 2 * (k + 1) - 2 * log_likelihood,
            "bic": None if log_likelihood is None else math.log(n) * (k + 1) - 2 * log_likelihood,
            "skew": skew,
            "kurtosis": kurtosis,
            "jarque_bera": bera,
            "jarque_bera_p_value": None if bera is None else chi_square_tail_2(bera),
            "durbin_watson": watson,
            "condition_number": condition if math.isfinite(condition) else None,
            "collinear": self.collinear,
        }
        kinds = {"rows": "long", "collinear": "boolean"}
        schema = ", ".join(f"{name} {kinds.get(name, 'double')}" for name in values)
        return self.rows.sparkSession.createDataFrame([tuple(values.values())], schema)


def fit_ols(df: DataFrame, label: str, features: Sequence[str]) -> OlsFit:
    """Least squares with an intercept over the rows complete in all columns."""
    features = list(features)
    rows = df.na.drop(subset=[label, *features])
    return OlsFit(LeastSquares(*triangular_factor(rows, [*features, label])), label, features, rows)
