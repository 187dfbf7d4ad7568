"""Per-series feature calculators (F-1 … F-39), one module per family.

Input is the long ``series(series_id, channel, t, x, …)`` table with dense
``t``; every family returns one wide row per ``(series_id, channel)``.
:func:`sigframe.operators.features.naming.to_long` turns any family into
``features(series_id, feature, value)`` rows named
``<channel>__<calculator>__<param>_<value>``.

Nothing partitions by the series key alone: aggregates are partial (map-side
combined); order-dependent families use the block/halo decomposition of
:mod:`sigframe.operators.ordering`; stats needed per point are joined back
(AQE broadcasts small stat tables and splits skewed partitions otherwise).
"""

KEY = ["series_id", "channel"]
