"""Normalisation of names and prefixes: the one function that needs Python, for Unicode forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.config import Config
from kinloom.functions import text as T

_ONE = str.maketrans({**dict(zip(*T.ONE_TO_ONE, strict=True)), **T.ONE_TO_MANY})
_GERMAN = str.maketrans({**dict(zip(*T.ONE_TO_ONE, strict=True)), **T.ONE_TO_MANY, **T.GERMAN})
_LEET = str.maketrans(*T.LEET)
_PUNCTUATION = re.compile(T.PUNCTUATION)
_STAMPS = (re.compile(r"^\s*\d+:\d+:\d+\s+"), re.compile(r"\s+\d+:\d+:\d+\s*$"))


@lru_cache(maxsize=8)
def _ends(zones: bool, years: bool) -> tuple[re.Pattern, list[re.Pattern]]:
    """What any of the patterns needs to match, and the patterns in their order."""
    words = [*(T.TIMEZONES if zones else ()), *(T.YEARS if years else ())]
    every = "|".join(words) or "(?!)"
    return re.compile(rf"^(?:{every})\s|\s(?:{every})$"), [p for w in words for p in (re.compile(rf"^{w}\s+"), re.compile(rf"\s+{w}$"))]


def normaliser(config: Config) -> Callable[[str | None, bool, bool], str | None]:
    """A plain function (text, german, leet) -> normal form, None for None."""
    titles, first = frozenset(T.TITLES), frozenset(n.lower() for n in config.first_names)
    some, ends = _ends(config.remove_timezones, config.remove_years)

    def normalise(text: str | None, german: bool, leet: bool) -> str | None:
        if text is None:
            return None
        text = text.lower()
        if config.normalize_unicode_nfc:
            text = unicodedata.normalize("NFC", text)
        if leet:
            text = text.translate(_LEET)
        if config.remove_timestamps and ":" in text:
            for pattern in _STAMPS:
                text = pattern.sub("", text)
        if some.search(text):
            for pattern in ends:
                text = pattern.sub("", text)
        words = text.split()
        if config.remove_titles:
            words = [w for w in words if w not in titles]
        text = " ".join(words)
        if not text.isascii():  # the maps and marks are outside ASCII
            text = text.translate(_GERMAN if german else _ONE)
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        if config.remove_punctuation:
            text = _PUNCTUATION.sub("", text)
        words = text.split()
        if config.remove_middle_names and len(words) == 3 and (len(words[1]) == 1 or words[1].lower() in first):
            words = [words[0], words[2]]
        return " ".join(words)

    return normalise


def uses_german(text: str, domain: str | None) -> bool:
    return bool(text) and (bool(domain) and domain.lower().endswith(tuple(T.GERMAN_DOMAINS)) or "ß" in text.lower())


def _of_each(texts: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    """The list of ``of(text)`` for each list of texts; nulls stay. A batch's repeated texts are worked out once, and lists are
    told by their lengths, so that no row becomes a Python object."""
    coded = texts.flatten().dictionary_encode()
    values = pa.array([of(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(texts), 0).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), values, mask=texts.is_null())


def forms_udf(config: Config):
    """array<string> -> array<array<string>>: of each text its one to four distinct normal forms,
    with and without German customs and leetspeak."""

    @F.arrow_udf("array<array<string>>")
    def forms(texts: pa.Array) -> pa.Array:
        normalise = normaliser(config)

        def of(text):
            # German customs are about letters outside ASCII, leetspeak about its own characters
            german, leet = not text.isascii(), not _LEET.keys().isdisjoint(map(ord, text))
            return sorted({normalise(text, g, k) for g in {german, False} for k in {leet, False}})

        return _of_each(texts, of, pa.list_(pa.string()))

    return forms


def unicode_udf(form: str = "NFC", marks: bool = True):
    """string -> string in a Unicode normal form, without combining marks if ``marks`` is false."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        def of(text):
            text = unicodedata.normalize(form, text)
            return text if marks else "".join(c for c in text if unicodedata.category(c) != "Mn")

        return texts.map(lambda t: None if t is None else of(t))

    return normal


def clean_text(c: Column) -> Column:
    """NFC, without control characters."""
    return T.drop_controls(unicode_udf()(c))


def single_udf(config: Config):
    """array<string> -> array<string>: normal forms by the configured leetspeak and no domain."""

    @F.arrow_udf("array<string>")
    def single(texts: pa.Array) -> pa.Array:
        normalise = normaliser(config)
        return _of_each(texts, lambda t: normalise(t, uses_german(t, None), config.normalize_leetspeak), pa.string())

    return single
