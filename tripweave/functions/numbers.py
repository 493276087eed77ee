"""Number formatting and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def human_number(x: Column, decimals: int = 2) -> Column:
    """``1234567`` -> ``1.23M``, ``1234`` -> ``1.23K``, smaller numbers plain."""
    fmt = f"%.{decimals}f"
    size = F.abs(x)
    return (
        F.when(size >= 1e6, F.format_string(fmt + "M", F.round(x / 1e6, decimals)))
        .when(size >= 1e3, F.format_string(fmt + "K", F.round(x / 1e3, decimals)))
        .otherwise(F.format_string(fmt, F.round(x, decimals)))
    )


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def r_mean(x: Column, digits: int = 6) -> Column:
    """Round a mean of short decimals.

    Such means often end exactly on half a unit of the last digit, where the
    last bit of the sum would decide.  A shift far below the digit settles it.
    """
    return F.round(x + F.lit(3e-9), digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function.

    Rational approximation by P. J. Acklam, relative error below 1.2e-9.
    """
    # Published coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)

    def poly(coefs, x):
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + F.lit(k)
        return out

    lo = 0.02425
    ql = F.sqrt(F.log(p) * -2.0)
    qh = F.sqrt(F.log(F.lit(1.0) - p) * -2.0)
    qm = p - 0.5
    rm = qm * qm
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < lo, poly(c, ql) / (poly(d, ql) * ql + 1.0))
        .when(p > 1 - lo, -poly(c, qh) / (poly(d, qh) * qh + 1.0))
        .otherwise(poly(a, rm) * qm / (poly(b, rm) * rm + 1.0))
    )
