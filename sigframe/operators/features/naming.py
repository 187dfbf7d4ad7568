"""F-39 feature naming and the wide -> long feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY


def fmt_value(v) -> str:
    """Parameter value text: integers without a decimal point, floats as repr."""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v.is_integer() and abs(v) >= 1e12:
        return repr(v)
    if isinstance(v, str):
        return f'"{v}"'
    return repr(v)


def feature_name(calc: str, **params) -> str:
    """``<calc>__<p1>_<v1>__<p2>_<v2>`` (parameters in the given order)."""
    parts = [calc] + [f"{k}_{fmt_value(v)}" for k, v in params.items()]
    return "__".join(parts)


# column name -> feature text, filled as families name their columns
FEATURE_TEXT: dict[str, str] = {}


def column_name(calc: str, **params) -> str:
    """Column-safe twin of :func:`feature_name` (used for wide family outputs)."""
    text = feature_name(calc, **params)
    name = text
    for a, b in (('"', ""), (".", "p"), ("-", "m"), (" ", "")):
        name = name.replace(a, b)
    FEATURE_TEXT[name] = text
    return name


def to_long(wide: DataFrame, names: dict[str, str] | None = None,
            keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Unpivot a family's wide output into ``(series_id, feature, value)``.

    ``names`` maps column -> feature text (defaults to the column name); the
    feature is prefixed with its channel.  NULL values are kept.
    """
    keys = list(keys)
    cols = [c for c in wide.columns if c not in keys]
    names = names if names is not None else FEATURE_TEXT
    entries = F.array(*[F.struct(F.lit(names.get(c, c)).alias("calc"),
                                 F.col(c).cast("double").alias("value")) for c in cols])
    return wide.select(*keys, F.inline(entries)).select(
        "series_id", F.concat_ws("__", "channel", "calc").alias("feature"), "value")
