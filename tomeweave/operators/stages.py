"""ML stages that Spark does not ship: document statistics, smoothed idf, block weights."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.operators.profile import document_stats
from tomeweave.operators.terms import vocabulary_cut
from tomeweave.sources.workspace import materialise

# Beyond this a linear model's terms do not fit a driver of a few GB.
MOST_TERMS = 20_000_000

STATS_COLUMNS = ("length", "num_sentences", "avg_sentence_length")


class DocumentStats(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the statistics of a text column as numeric columns, 0 for an empty text."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text"):
        super().__init__()
        self._setDefault(inputCol="text")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return document_stats(dataset, self.getInputCol()).na.fill(0.0, ["avg_sentence_length"])


class SmoothedIdf(
    Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Fits idf = ln((1 + n) / (1 + df)) + 1; the built-in IDF lacks the last term.

    The fitted stage is the built-in ElementwiseProduct, so it saves and loads like any other.
    """

    @keyword_only
    def __init__(self, *, inputCol: str = "counts", outputCol: str = "weighted"):
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="weighted")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(dataset).idf
        return ElementwiseProduct(
            scalingVec=Vectors.dense(idf.toArray() + 1.0),
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
        )


class TermVocabulary(
    Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Fits the terms that are counted: all of them, or the most frequent ``vocabSize``.

    Terms are ordered by total count, equal counts by the term itself, so a vocabulary does not
    depend on how the rows are partitioned. The fitted stage is the built-in counter. Its
    vocabulary and a model's coefficients live on the driver: more than ``MOST_TERMS`` terms are
    an error, never a cut.
    """

    vocabSize = Param(Params._dummy(), "vocabSize", "most frequent terms to keep, 0 for all", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "tokens", outputCol: str = "counts", vocabSize: int = 0):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="counts", vocabSize=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        # The outer form keeps the optimizer from making the tokens twice more, in a filter for empty arrays.
        tokens = dataset.select(F.explode_outer(self.getInputCol()).alias("term"))
        counts = tokens.groupBy("term").agg(F.count("*").alias("n")).where("term IS NOT NULL")
        frequencies = materialise(counts, "terms")
        size = self.getOrDefault(self.vocabSize)
        kept = vocabulary_cut(frequencies, size) if size else frequencies
        found = kept.count()
        if found > MOST_TERMS:
            raise ValueError(f"{found} terms; a linear model holds {MOST_TERMS} at most: set vocabSize")
        # A counter needs a term; a blank one occurs in no text.
        ordered = kept.orderBy(F.desc("n"), F.asc("term")) if found else dataset.sparkSession.sql("SELECT ' ' AS term")
        return _counter(ordered.select("term"), max(found, 1), self.getInputCol(), self.getOutputCol())


def _counter(terms: DataFrame, size: int, column: str, output: str) -> CountVectorizerModel:
    """``CountVectorizerModel.from_vocabulary`` of a column of terms, which stay in the JVM.

    That method calls it for each term, which takes about a minute a million.
    """
    strings = terms.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    vocabulary = getattr(terms._jdf, "as")(strings).collect()
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", vocabulary)
    return model.setInputCol(column).setOutputCol(output)._set(vocabSize=size)


class BlockWeight(
    Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Multiplies a feature block by one weight, for use before blocks are assembled."""

    weight = Param(Params._dummy(), "weight", "factor", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "block", weight: float = 1.0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="block", weight=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        size = dataset.select(self.getInputCol()).first()[0].size
        return ElementwiseProduct(
            scalingVec=Vectors.dense([self.getOrDefault(self.weight)] * size),
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
        )
