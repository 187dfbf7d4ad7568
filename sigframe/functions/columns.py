"""Scalar column helpers shared by the operators.

All helpers build ``pyspark.sql.Column`` expressions so they stay inside
whole-stage codegen.  Each one has a one-line SQL twin used by the oracle
queries (see ``sigframe.plans.oracle``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

# Abramowitz & Stegun 7.1.26 rational approximation of erf
# (max abs error 1.5e-7); public constants of the formula.
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den`` with NULL when ``den`` is 0 or NULL (never an ANSI error)."""
    den = _col(den)
    return F.when(den != 0, _col(num) / den)


def normal_two_sided_p(z) -> Column:
    """Two-sided normal tail ``P(|Z| >= |z|)`` via A&S 7.1.26 (erf is missing in SQL)."""
    x = F.abs(_col(z)) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * x)
    poly = F.lit(0.0)
    for a in reversed(AS_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def hash_fold(key, k: int) -> Column:
    """Deterministic fold number 0..k-1 from the md5 of a key (replaces unseeded shuffles)."""
    h = F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % k).cast("int")


def sanitize_name(c) -> Column:
    """Delete every character outside ``[A-Za-z0-9_]`` (feature-name clean-up)."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_]", "")


def round_sig(c, digits: int = 8) -> Column:
    """Round to ``digits`` decimals of the mantissa for |x| >= 1 (to ``digits``
    decimals below 1); |x| < 1e-9 becomes 0.

    Written as explicit IEEE steps (scale, half-away-from-zero, unscale) so
    the SQL twin in ``plans.oracle.rs`` yields bit-identical doubles.
    """
    x = _col(c).cast("double")
    p = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.abs(x))), F.lit(0)).cast("double"))
    scale = float(10 ** digits)
    t = x / p * F.lit(scale)
    rounded = F.signum(t) * F.floor(F.abs(t) + F.lit(0.5001)) / F.lit(scale) * p
    return F.when(F.abs(x) < 1e-9, F.lit(0.0)).otherwise(rounded)


def round_doubles(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every floating column (see :func:`round_sig`) for cross-engine hashing."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(round_sig(F.col(f"`{f.name}`"), digits).alias(f.name))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (DoubleType, FloatType)):
            out.append(F.transform(F.col(f"`{f.name}`"), lambda v: round_sig(v, digits)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
