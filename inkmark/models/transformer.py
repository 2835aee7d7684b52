"""The stylometric features as a Spark ML transformer."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from inkmark.functions import stylometry


class StylometricFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Appends the fifteen ``v2`` or the twenty-eight ``v1`` features as columns."""

    version = Param(Params._dummy(), "version", "feature set: v2 or v1", TypeConverters.toString)

    def __init__(self, inputCol: str = "text", version: str = "v2"):
        super().__init__()
        self._setDefault(inputCol="text", version="v2")
        self._set(inputCol=inputCol, version=version)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        add = {"v2": stylometry.add_v2_features, "v1": stylometry.add_v1_features}[self.getOrDefault(self.version)]
        return add(dataset, text=self.getInputCol())
