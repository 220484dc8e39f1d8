"""The steps from texts to tokens as a stage of an ML pipeline, with parameters that are saved."""

from __future__ import annotations

from dataclasses import asdict, fields

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from ..functions.cleaning import VARIANTS, clean
from .text import ENGLISH, TokenConfig, tokens_of


class TokenSteps(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Texts of ``inputCol`` cleaned and cut into tokens of ``outputCol``; other columns stay.

    ``cleaning`` names a variant of ``functions.cleaning``; the other parameters are those of
    `TokenConfig`. ``stop_words`` is a list; `english` in it stands for Spark's English list.
    """

    cleaning = Param(Params._dummy(), "cleaning", "variant of the cleaning rules", TypeConverters.toString)
    cleanup = Param(Params._dummy(), "cleanup", "what becomes of blanks", TypeConverters.toString)
    lowercase = Param(Params._dummy(), "lowercase", "whether tokens are lowered", TypeConverters.toBoolean)
    punctuation = Param(Params._dummy(), "punctuation", "whether punctuation splits or joins words", TypeConverters.toString)
    stop_words = Param(Params._dummy(), "stop_words", "words left out, or the name of a list", TypeConverters.toListString)
    extend_english = Param(Params._dummy(), "extend_english", "whether the English list is added", TypeConverters.toBoolean)
    stem = Param(Params._dummy(), "stem", "whether words are stemmed", TypeConverters.toBoolean)
    ngrams = Param(Params._dummy(), "ngrams", "sizes of n-grams", TypeConverters.toListInt)
    distinct = Param(Params._dummy(), "distinct", "whether each token of a row counts once", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol: str = "content", outputCol: str = "tokens", cleaning: str = "none", **switches) -> None:  # noqa: N803
        super().__init__()
        given = dict(self._input_kwargs)
        self._setDefault(inputCol="content", outputCol="tokens", cleaning="none", **_as_params(TokenConfig()))
        self._set(**given)
        if self.getOrDefault("cleaning") not in VARIANTS:
            raise ValueError(f"unknown cleaning variant {self.getOrDefault('cleaning')!r}")

    @classmethod
    def of(cls, config: TokenConfig, cleaning: str = "none", inputCol: str = "content", outputCol: str = "tokens") -> TokenSteps:  # noqa: N803
        return cls(inputCol=inputCol, outputCol=outputCol, cleaning=cleaning, **_as_params(config))

    def config(self) -> TokenConfig:
        values = {field.name: self.getOrDefault(field.name) for field in fields(TokenConfig)}
        words = tuple(values["stop_words"])
        values["stop_words"] = ENGLISH if words == (ENGLISH,) else words or None
        values["ngrams"] = tuple(values["ngrams"])
        return TokenConfig(**values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        given, made = self.getOrDefault("inputCol"), self.getOrDefault("outputCol")
        # The cleaned text is a column of its own, so that the given one stays.
        texts = clean(dataset.withColumn(made, dataset[given]), self.getOrDefault("cleaning"), made)
        return tokens_of(texts, self.config(), made, made)


def _as_params(config: TokenConfig) -> dict:
    values = asdict(config)
    words = values["stop_words"]
    values["stop_words"] = [words] if isinstance(words, str) else list(words or ())
    values["ngrams"] = list(values["ngrams"])
    return values
