"""Tail probabilities and quantiles as vectorized column functions.

Spark has no Student, F or chi-squared distribution functions.  The two
continued fractions below (Lentz evaluation of the incomplete beta and gamma
functions, in any numerical text book) give them in a few NumPy lines; they
run on result tables with one row per test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_TINY = 1e-300
#: A fraction has converged when a step changes it by less.  Steps keep changing it by
#: rounding errors, so each element stops at its own first small step.
STEP_ERROR = 4e-15


def _steps(*parameters) -> int:
    """Steps that the fractions may need: their number grows with the square root of the parameters."""
    return 1000 + int(40 * math.sqrt(max(float(np.max(p, initial=0.0)) for p in parameters)))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter((math.lgamma(v) for v in np.ravel(x)), float, np.size(x)).reshape(np.shape(x))


def beta_cdf(a, b, x):
    """Regularized incomplete beta function I_x(a, b), elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c = np.ones_like(y)
        d = 1.0 - (p + q) * y / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        h, done = d.copy(), np.zeros(y.shape, bool)
        for m in range(1, _steps(p, q)):
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            step = np.ones_like(y)
            for term in (even, odd):
                d = 1.0 + term * d
                c = 1.0 + term / c
                d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
                c = np.where(np.abs(c) < _TINY, _TINY, c)
                step = c * d
                h = np.where(done, h, h * step)
            done |= ~(np.abs(step - 1.0) >= STEP_ERROR)
            if done.all():
                break
        else:
            raise ArithmeticError("the incomplete beta function did not converge")
        out = front * h
    out = np.where(y <= 0.0, 0.0, out)
    return np.where(swap, 1.0 - out, out)


def gamma_tail(a, x):
    """Upper regularized incomplete gamma function Q(a, x), elementwise."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1.0 / a
        series = term.copy()
        for n in range(1, _steps(a)):
            term = term * x / (a + n)
            series = series + term
            if np.nanmax(np.where(x < a + 1, term / series, 0.0), initial=0.0) < 1e-17:
                break
        else:
            raise ArithmeticError("the incomplete gamma series did not converge")
        b = x + 1.0 - a
        c = np.full_like(b, 1.0 / _TINY)
        d = 1.0 / np.where(np.abs(b) < _TINY, _TINY, b)
        h, done = d.copy(), ~(x >= a + 1)
        for n in range(1, _steps(a)):
            an = -n * (n - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = np.where(done, h, h * step)
            done |= ~(np.abs(step - 1.0) >= STEP_ERROR)
            if done.all():
                break
        else:
            raise ArithmeticError("the incomplete gamma fraction did not converge")
        out = np.where(x < a + 1.0, 1.0 - front * series, front * h)
    return np.where(x <= 0.0, 1.0, out)


def student_tail(t, df):
    """P(T > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    half = 0.5 * beta_cdf(df / 2.0, 0.5, df / (df + t * t))
    return np.where(t >= 0, half, 1.0 - half)


def student_quantile(p, df):
    """t with P(T <= t) = p, by bisection on the tail; p >= 0.5."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e8)
    for _ in range(120):
        mid = 0.5 * (lo + hi)
        above = student_tail(mid, df) > 1.0 - p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return 0.5 * (lo + hi)


def _masked(fn, *series: pd.Series) -> pd.Series:
    """``fn`` on the rows where every input is a number; NULL elsewhere."""
    values = [pd.to_numeric(s).to_numpy(dtype=float, na_value=np.nan) for s in series]
    ok = np.logical_and.reduce([np.isfinite(v) for v in values])
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = fn(*[v[ok] for v in values])
    return pd.Series(out).astype(object).where(ok, None)


def _vectorized(fn, *cols) -> Column:
    if len(cols) == 2:
        @F.pandas_udf("double")
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return _masked(fn, a, b)
    elif len(cols) == 1:
        @F.pandas_udf("double")
        def call(a: pd.Series) -> pd.Series:
            return _masked(fn, a)
    else:
        @F.pandas_udf("double")
        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return _masked(fn, a, b, c)
    return call(*[F.col(c) if isinstance(c, str) else c for c in cols])


def t_p_value(t, df, alternative: str = "two-sided") -> Column:
    """p value of a t statistic: ``two-sided`` or ``less``."""
    if alternative == "less":
        return _vectorized(lambda a, b: student_tail(-a, b), t, df)
    return _vectorized(lambda a, b: 2.0 * student_tail(np.abs(a), b), t, df)


def f_p_value(f, df1, df2) -> Column:
    return _vectorized(lambda x, a, b: beta_cdf(b / 2.0, a / 2.0, b / (b + a * x)), f, df1, df2)


def chi2_p_value(x, df) -> Column:
    return _vectorized(lambda a, b: gamma_tail(b / 2.0, a / 2.0), x, df)


def t_quantile(df, p: float = 0.975) -> Column:
    return _vectorized(lambda n: student_quantile(p, n), df)
