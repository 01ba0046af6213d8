"""The operators as Spark ML stages, to be put into a Pipeline and saved with it."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.functions import scores as sc
from postsift.functions import text as tx
from postsift.operators import filters as fl
from postsift.operators.lexicon import psych_features
from postsift.operators.vectorize import TermModel
from postsift.plans.training import load_lexicons
from postsift.sources.staging import pin


class TextCleaner(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Cleaned text of `inputCol`, in lower case when `lower` is set."""

    lower = Param(Params._dummy(), "lower", "lower-case the result", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol: str = "post", outputCol: str = "text", lower: bool = True):
        super().__init__()
        self._setDefault(inputCol="post", outputCol="text", lower=True)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        text = tx.clean_text(F.col(self.getInputCol()))
        if self.getOrDefault(self.lower):
            text = tx.lower_text(text)
        return df.withColumn(self.getOutputCol(), text)


class DisclosureFilter(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `reason`, `post_cleaned`, `post_masked`; with `drop` rejected rows go."""

    threshold = Param(
        Params._dummy(), "threshold", "first-person rate to keep", TypeConverters.toFloat
    )
    drop = Param(Params._dummy(), "drop", "remove rejected rows", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, threshold: float = fv.FIRST_PERSON_THRESHOLD, drop: bool = False):
        super().__init__()
        self._setDefault(threshold=fv.FIRST_PERSON_THRESHOLD, drop=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = fl.clinical_filter(df, self.getOrDefault(self.threshold))
        return fl.drop_incomplete(out, ["post_cleaned"]) if self.getOrDefault(self.drop) else out


class SoftmaxScores(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Decision scores (vector or array) to an array of pseudo-probabilities."""

    @keyword_only
    def __init__(self, *, inputCol: str = "rawPrediction", outputCol: str = "p"):
        super().__init__()
        self._setDefault(inputCol="rawPrediction", outputCol="p")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.getInputCol()
        is_vector = isinstance(df.schema[name].dataType, VectorUDT)
        scores = vector_to_array(name) if is_vector else F.col(name)
        return df.withColumn(self.getOutputCol(), sc.softmax(scores))


class PsychFeatures(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Vector of the 99 lexicon features; `lexicons` names the folder of the lexicon tables."""

    lexicons = Param(Params._dummy(), "lexicons", "folder of lexicon tables", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, lexicons: str = "", inputCol: str = "text", outputCol: str = "psych"):
        super().__init__()
        self._setDefault(lexicons="", inputCol="text", outputCol="psych")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        tables = load_lexicons(df.sparkSession, self.getOrDefault(self.lexicons))
        wide = psych_features(df, tables, self.getInputCol())
        names = [c for c in wide.columns if c != "post_id"]
        vectors = VectorAssembler(inputCols=names, outputCol=self.getOutputCol()).transform(wide)
        return df.join(vectors.select("post_id", self.getOutputCol()), "post_id")


class TfidfChi2Vectorizer(
    Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Fits vocabulary, inverse document frequency, chi-square selection and scale."""

    sizes = Param(
        Params._dummy(), "sizes", "word vocabulary, char vocabulary, words kept, char n-grams kept",
        TypeConverters.toListInt,
    )

    @keyword_only
    def __init__(
        self, *, inputCol: str = "text", outputCol: str = "tfidf", labelCol: str = "label",
        sizes: list[int] = None,
    ):
        super().__init__()
        full = [fv.WORD_VOCABULARY, fv.CHAR_VOCABULARY, fv.WORD_SELECTED, fv.CHAR_SELECTED]
        self._setDefault(inputCol="text", outputCol="tfidf", labelCol="label", sizes=full)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "TfidfChi2Model":
        rows = pin(df.select("post_id", self.getLabelCol(), self.getInputCol()), "labelled")  # read by each pass
        fitted = TermModel.fit(rows, self.getLabelCol(), self.getInputCol(), *self.getOrDefault(self.sizes))
        model = TfidfChi2Model(fitted)
        model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return model


class TfidfChi2Model(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """The fitted vectorizer; its terms are stored as a table beside the metadata."""

    def __init__(self, fitted: TermModel | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.fitted.attach(df, self.getInputCol(), self.getOutputCol())

    def write(self) -> MLWriter:
        return _TermWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TermReader(cls)


class _TermWriter(MLWriter):
    def __init__(self, model: TfidfChi2Model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.save(f"{path}/terms")


class _TermReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TfidfChi2Model:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(TermModel.load(self.sparkSession, f"{path}/terms"))
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
