"""Fitted transforms that can be stored (G1-G8): Estimator / Model pairs with
Spark ML persistence.

``Terms`` (G1, G2), ``TfIdf`` (G3-G5), ``Scaler`` (G6, G7) and Spark's own
``VectorAssembler`` (G8) form one ``Pipeline``. It is fitted once on the training
rows, written with ``model.write().save(path)``, and ``PipelineModel.load(path)``
in any later session applies exactly what was fitted: nothing is recomputed from
the data, and test rows never reach a fit.

A fit brings one row (the scaler's statistics) or at most ``maxFeatures`` terms
to the driver; the vocabulary is kept and stored as a table.
"""

from __future__ import annotations

import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.operators import features as G


class Terms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """G1 + G2 as a stage: the terms of a text column (see ``features.with_terms``)."""

    ngramLow = Param(Params._dummy(), "ngramLow", "shortest n-gram", TypeConverters.toInt)
    ngramHigh = Param(Params._dummy(), "ngramHigh", "longest n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words left out", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, ngramLow=1, ngramHigh=1, stopWords=None):
        super().__init__()
        self._setDefault(ngramLow=1, ngramHigh=1, stopWords=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        of = self.getOrDefault
        return G.with_terms(df, self.getInputCol(), self.getOutputCol(), (of(self.ngramLow), of(self.ngramHigh)), of(self.stopWords) or None)


class _TfIdfParams(HasInputCol, HasOutputCol):
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most terms of the vocabulary", TypeConverters.toInt)

    def getMaxFeatures(self) -> int:
        return self.getOrDefault(self.maxFeatures)


class TfIdf(Estimator, _TfIdfParams, DefaultParamsReadable, DefaultParamsWritable):
    """G3-G5 as a stage: vocabulary and idf of a terms column, and the unit
    TF-IDF vectors over them."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, maxFeatures=5000):
        super().__init__()
        self._setDefault(maxFeatures=5000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TfIdfModel:
        vocabulary = G.fit_vocabulary(df.select(self.getInputCol()), self.getInputCol(), self.getMaxFeatures())
        return self._copyValues(TfIdfModel(vocabulary))


class TfIdfModel(Model, _TfIdfParams, MLReadable, MLWritable):
    """``vocabulary``: the stored table (term, tf, df, idf, index, rank)."""

    def __init__(self, vocabulary: DataFrame | None = None):
        super().__init__()
        self._setDefault(maxFeatures=5000)
        self.vocabulary = vocabulary
        self._stages = None

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._stages is None:  # one look at the vocabulary per model
            self._stages = G.tfidf_vectorizer(self.vocabulary, self.getInputCol(), self.getMaxFeatures(), self.getOutputCol())
        some = F.coalesce(F.col(self.getInputCol()), F.array().cast("array<string>"))  # a null text has no terms
        return self._stages.transform(df.withColumn(self.getInputCol(), some)).drop("_tf", "_tfidf")

    def write(self) -> MLWriter:
        return _TfIdfWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TfIdfReader(cls)


class _TfIdfWriter(MLWriter):
    def __init__(self, instance: TfIdfModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.vocabulary.write.parquet(os.path.join(path, "vocabulary"))


class _TfIdfReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TfIdfModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(os.path.join(path, "vocabulary")))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _ScalerParams(HasInputCols):
    suffix = Param(Params._dummy(), "suffix", "added to the column names", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "standard or minmax", TypeConverters.toString)


class Scaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """G6 (``kind='standard'``) and G7 (``kind='minmax'``) as a stage."""

    @keyword_only
    def __init__(self, *, inputCols=None, suffix="_scaled", kind="minmax"):
        super().__init__()
        self._setDefault(suffix="_scaled", kind="minmax")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ScalerModel:
        cols, kind = self.getInputCols(), self.getOrDefault(self.kind)
        if kind == "standard":
            row = G.fit_standard_scaler(df, cols).first()  # one row
            centres, scales = [row[f"{c}__mean"] for c in cols], [row[f"{c}__std"] for c in cols]
        elif kind == "minmax":
            row = G.fit_minmax_scaler(df, cols).first()  # one row
            centres = [row[f"{c}__min"] for c in cols]
            scales = [None if lo is None else row[f"{c}__max"] - lo for c, lo in zip(cols, centres)]
        else:
            raise ValueError("kind is standard or minmax")
        model = ScalerModel()
        # no training row: nothing to subtract, nothing to divide by
        model._set(centres=[0.0 if c is None else c for c in centres], scales=[s or 1.0 for s in scales])
        return self._copyValues(model)


class ScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - centre) / scale per column; a column without spread divides by 1."""

    centres = Param(Params._dummy(), "centres", "subtracted", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "divided by", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(suffix="_scaled", kind="minmax")

    def _transform(self, df: DataFrame) -> DataFrame:
        centres, scales = self.getOrDefault(self.centres), self.getOrDefault(self.scales)
        names = [c + self.getOrDefault(self.suffix) for c in self.getInputCols()]
        return df.withColumns({n: (F.col(c) - F.lit(m)) / F.lit(s) for n, c, m, s in zip(names, self.getInputCols(), centres, scales)})
