"""Column expressions: prices, probabilities, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """A double, or null for what is no finite number."""
    x = F.expr(f"try_cast(`{c}` AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def flag(c: Column | str) -> Column:
    """True for 1 and the usual words for yes; false for all else, nulls included."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "1.0", "true", "yes", "y"), F.lit(False))


def american_to_decimal(price: Column | str) -> Column:
    p = col(price).cast("double")
    return F.when(p > 0, 1 + p / 100).when(p < 0, 1 + 100 / -p)


def american_to_implied(price: Column | str) -> Column:
    p = col(price).cast("double")
    return F.when(p > 0, 100 / (p + 100)).when(p < 0, -p / (100 - p))


def decimal_to_american(price: Column | str) -> Column:
    d = col(price).cast("double")
    return F.when(d >= 2, (d - 1) * 100).when(d > 1, -100 / (d - 1))


#: Abramowitz and Stegun 7.1.26.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column | str) -> Column:
    """Absolute error below 1.5e-7; whole-stage code, no Python.

    The curve stands once, outside of any branch, so that its parts are evaluated once a row in one small method.
    """
    x = F.abs(col(z)) / F.lit(2.0**0.5)
    t = 1 / (1 + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = 1 - poly * F.exp(-x * x)
    return (1 + F.when(col(z) < 0, -1.0).otherwise(1.0) * erf) / 2


def normal_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / {2.0**0.5!r}::DOUBLE)"
    t = f"(1 / (1 + {ERF_P}::DOUBLE * {x}))"
    poly = "0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}::DOUBLE) * {t})"
    return f"(CASE WHEN {z} < 0 THEN (1 - (1 - {poly} * exp(-{x} * {x}))) / 2 ELSE (1 + (1 - {poly} * exp(-{x} * {x}))) / 2 END)"


def clipped(p: Column | str, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))


def log_loss(p: Column | str, y: Column | str, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return -(col(y) * F.log(q) + (1 - col(y)) * F.log(1 - q))


def side_label(edge: Column | str, tolerance: float = 1e-9) -> Column:
    """1 or 0 by the sign of the edge; null on a push and for what is not finite."""
    e = col(edge)
    return F.when(F.isnan(e) | (F.abs(e) == float("inf")) | (F.abs(e) <= tolerance), None).otherwise((e > 0).cast("int"))


def canonical_name(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Upper case, one space between words, no punctuation, aliases resolved; an empty name is null."""
    x = F.trim(F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]+", " "))
    x = F.when(x != "", x)
    if aliases:
        table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
        x = F.coalesce(F.try_element_at(table, x), x)
    return x
