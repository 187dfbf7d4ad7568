"""sigframe — labelled multichannel time-series analytics as Spark DataFrame operators.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects.  The
canonical long shapes are:

* ``series(series_id, subject, target, channel, t, x)`` — one row per point,
  ``t`` a dense 0-based position inside ``(series_id, channel)``;
* ``features(series_id, feature, value)`` — one row per computed feature;
* ``predictions(dataset, classifier, fold, id, y, yhat)`` and
  ``scores(dataset, classifier, accuracy, precision, recall, f1)``.
"""

__version__ = "0.1.0"
