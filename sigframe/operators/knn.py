"""k nearest neighbours as a Spark ML estimator (M-4, M-12, S-12), so that it can
be a stage of a pipeline, be passed as a value, stored and loaded.

The model is its training rows, a table.  Applying it is the block join of
``neighbours``; nothing of it goes through the driver.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators.neighbours import BLOCK_ROWS, nearest, vote
from sigframe.session import cut_lineage


class _KnnParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "whole distinct ids of the training rows, which break ties", TypeConverters.toString)
    blockRows = Param(Params._dummy(), "blockRows", "rows a block", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", k=7, idCol="id",
                         blockRows=BLOCK_ROWS)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def setK(self, value: int):
        return self._set(k=value)

    def _vector(self, dataset: DataFrame) -> Column:
        name = self.getOrDefault("featuresCol")
        col = dataset[name]
        return vector_to_array(col) if isinstance(dataset.schema[name].dataType, VectorUDT) else col.cast("array<double>")


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


class NearestNeighbours(Estimator, _KnnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the rows to vote; labels are whole numbers.  Rows with a null id, label
    or features, or with a null or NaN component, do not vote."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", k=7, idCol="id",
                 blockRows=BLOCK_ROWS):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NearestNeighboursModel:
        rows = dataset.select(F.col(self.getOrDefault("idCol")).cast("long").alias("id"),
                              F.col(self.getOrDefault("labelCol")).cast("long").alias("y"),
                              self._vector(dataset).alias("features"))
        model = NearestNeighboursModel(rows.where(F.col("id").isNotNull() & F.col("y").isNotNull() & _whole("features")))
        return self._copyValues(model)


class NearestNeighboursModel(Model, _KnnParams, MLReadable, MLWritable):
    """``rows(id, y, features)`` and the parameters.  ``transform`` adds the most
    frequent label of a row's k nearest, as a double: ties in distance go to the
    smaller id, ties in votes to the smaller label.  All rows and columns are kept;
    rows without whole features, and all rows of a model without rows, get null."""

    def __init__(self, rows: DataFrame | None = None):
        super().__init__()
        self._defaults()
        self.rows = rows

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, own = dataset.columns, "_knn_row"
        while own in names:
            own += "_"
        # numbered once: the rows go to the join and come back to their numbers
        data = cut_lineage(dataset.withColumn(own, F.monotonically_increasing_id()))
        asked = data.select(F.col(own).alias("id"), F.lit(0).alias("grp"), self._vector(data).alias("features")).where(
            _whole("features"))
        found = nearest(asked, self.rows.withColumn("grp", F.lit(1)), self.getOrDefault("k"), self.getOrDefault("blockRows"))
        out = vote(found).select(F.col("id").alias(own), F.col("yhat").cast("double").alias(self.getOrDefault("predictionCol")))
        return data.join(out, own, "left").drop(own)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: NearestNeighboursModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.rows.write.mode("overwrite").parquet(f"{path}/rows")


class _Reader(MLReader):
    def load(self, path: str) -> NearestNeighboursModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = NearestNeighboursModel(spark.read.parquet(f"{path}/rows"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
