"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness of an aggregate; 0 for under three values or constant ones."""
    n = F.count(x).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when((n > 2) & (F.min(x) < F.max(x)), F.coalesce(F.skewness(x) * factor, F.lit(0.0))).otherwise(F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are known; null where either is constant (by range, as moments that are merged
    over partitions may leave a constant some rounding for a spread)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def regression_metrics(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates over (actual, predicted). R2 of a constant actual is 1 if all is exact, else 0."""
    error = y - p
    sse, sst = F.sum(error * error), F.var_pop(y) * F.count(y)
    n_exact = F.sum(F.when(error == 0, 0).otherwise(1))
    return {
        "mae": F.avg(F.abs(error)),
        "mse": F.avg(error * error),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(F.min(y) < F.max(y), 1 - F.try_divide(sse, sst)).otherwise(F.when(n_exact == 0, 1.0).otherwise(0.0)),
        "median_ae": F.median(F.abs(error)),
        "mape_pct": F.avg(F.when(y != 0, F.abs(F.try_divide(error, y)))) * 100,
    }


# Coefficients of a published rational approximation of the normal quantile (P. J. Acklam).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def normal_quantile_sql(p: str) -> str:
    """SQL text of the standard normal quantile of p (0 < p < 1), good to about 1e-9; for any engine."""
    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    low, high = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))"
    tail = lambda x: f"({_horner(_C, x)}) / ({_horner(_D, x)})"
    middle = f"({_horner(_A, r)}) * {q} / ({_horner(_B, r)})"
    return f"CASE WHEN {p} < {_TAIL}e0 THEN {tail(low)} WHEN {p} > {1 - _TAIL}e0 THEN -({tail(high)}) ELSE {middle} END"


def normal_quantile(p: str) -> Column:
    return F.expr(normal_quantile_sql(p))


def order_median_sql(i: str, n: str) -> str:
    """Filliben's estimate of the median of the i-th of n uniform order statistics, as SQL text."""
    return f"CASE WHEN {i} = 1 THEN 1e0 - power(0.5e0, 1e0 / {n}) WHEN {i} = {n} THEN power(0.5e0, 1e0 / {n}) ELSE ({i} - 0.3175e0) / ({n} + 0.365e0) END"


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin (from 0) of x among equal ones from low to high, which belongs to the last."""
    width = (high - low) / bins
    return F.when(high > low, F.least(F.floor((x - low) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
