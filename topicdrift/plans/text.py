"""From texts to token lists, steered by switches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions import tokens as words
from ..functions.stemming import stem_tokens
from ..operators.terms import lemmatize

ENGLISH = "english"


@dataclass(frozen=True)
class TokenConfig:
    """Switches of the token steps, in the order they run.

    ``stop_words``: ``"english"`` for Spark's list, a tuple for an own list, ``None`` for
    none. An own list replaces the English one unless ``extend_english`` is set.
    ``ngrams``: sizes; the lists of several sizes are joined. ``distinct``: each entry of
    a row once, so that counts are 0 or 1.
    """

    cleanup: str = words.SHRINK
    lowercase: bool = True
    punctuation: str = "split"
    stop_words: str | tuple[str, ...] | None = ENGLISH
    extend_english: bool = False
    stem: bool = False
    ngrams: tuple[int, ...] = (1,)
    distinct: bool = False

    def stop_list(self) -> list[str]:
        if self.stop_words is None:
            return []
        if self.stop_words == ENGLISH:
            return words.english_stop_words()
        return list(self.stop_words) + (words.english_stop_words() if self.extend_english else [])


def token_table(
    df: DataFrame,
    config: TokenConfig,
    keys: Sequence[str],
    content: str = "content",
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """``(keys, tokens)``. Without lemmas this is one narrow pass over the texts."""
    if lemmas is None:
        return tokens_of(df.select(*keys, F.col(content).alias("tokens")), config, "tokens", "tokens")
    plain = tokens_of(df.select(*keys, F.col(content).alias("tokens")), replace(config, stem=False, ngrams=(1,), distinct=False), "tokens", "tokens")
    return _finished(lemmatize(plain, lemmas, keys), config, "tokens")


def tokens_of(df: DataFrame, config: TokenConfig, content: str, tokens: str) -> DataFrame:
    """``df`` with the tokens of a text column; all steps but lemmas, which need keys."""
    if config.cleanup not in (words.SHRINK, words.DISABLED):
        raise ValueError(f"cleanup must be 'shrink' or 'disabled', not {config.cleanup!r}")
    # Both clean-up modes give the same tokens, which hold no blanks: neither is run.
    cut = words.tokenize(F.col(content), config.lowercase, config.punctuation)
    return _finished(df.withColumn(tokens, words.remove_stop_words(cut, config.stop_list())), config, tokens)


def plain_form(config: TokenConfig) -> TokenConfig:
    """What settings that can share their token lists have in common: all but case, stems and n-grams."""
    return replace(config, cleanup=words.SHRINK, lowercase=False, stem=False, ngrams=(1,), distinct=False)


def form_of(config: TokenConfig) -> str:
    """Name of the column of `form_table` that has a setting's single words."""
    return ("lower" if config.lowercase else "cased") + ("_stem" if config.stem else "")


def form_table(df: DataFrame, configs: Sequence[TokenConfig], keys: Sequence[str], content: str = "content") -> DataFrame:
    """``(keys, a column per form)``: the single words of settings with the same `plain_form`.

    Texts are cut once. Lower case and stems are made of the words already cut; stop words are
    matched ignoring case, so they are the same for all forms.
    """
    cut = tokens_of(df.select(*keys, F.col(content).alias("cased")), plain_form(configs[0]), "cased", "cased")
    cut = cut.withColumn("lower", F.transform("cased", F.lower))
    forms = dict.fromkeys(map(form_of, configs))
    for form in forms:
        if form.endswith("_stem"):
            plain = form.removesuffix("_stem")
            cut = cut.withColumn(form, F.col(plain)).withColumn(form, stem_tokens(form))
    return cut.select(*keys, *forms)


def tokens_of_form(forms: DataFrame, config: TokenConfig, keys: Sequence[str]) -> DataFrame:
    """``(keys, tokens)`` of one setting, out of the words of its form."""
    tokens = words.combined_ngrams(F.col(form_of(config)), config.ngrams, config.distinct)
    return forms.select(*keys, tokens.alias("tokens"))


def _finished(df: DataFrame, config: TokenConfig, tokens: str) -> DataFrame:
    if config.stem:
        df = df.withColumn(tokens, stem_tokens(tokens))
    if config.ngrams != (1,) or config.distinct:
        df = df.withColumn(tokens, words.combined_ngrams(F.col(tokens), config.ngrams, config.distinct))
    return df
