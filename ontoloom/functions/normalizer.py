"""Label transformations N1 to N12: each is an expression, and normalize_terms folds the chosen ones into one projection.

Operations run in reverse alphabetical order whatever the order they are given in, each as often as it is named.
A tokenized value is a list and stays as it is: the operations that would follow leave it alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemming import lemma, stem_english, treebank

# Names of the Greek letters in their order from U+0391 and U+03B1 (U+03C2 is the final sigma).
GREEK_CAPITALS = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Ypsilon Phi Chi Psi Omega".split()
GREEK = {chr(0x391 + k + (k > 16)): n for k, n in enumerate(GREEK_CAPITALS)}
GREEK |= {c.lower(): n.lower() for c, n in GREEK.items()} | {"ς": "sigma"}
# Typographic signs and their plain forms.
TYPOGRAPHIC = ("−–—“”‘’", "---\"\"''")
# The signs that count as punctuation.
PUNCTUATION = r"[_\.,;:!?\*‐\-–—#<>\(\)\[\]„“”‘’'\"/\\\|%\^~`$=\+{}@\&′″、]"
#: Letters without a decomposition, and their ASCII forms.
ASCII_OF = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "€": "EUR", "ς": "s"}
GREEK_ASCII = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "a b g d e z e th i k l m n x o p r s t u ph kh ps o".split(), strict=True))


def greekchars(x: Column) -> Column:
    """N1"""
    names = F.create_map(*(F.lit(v) for kv in GREEK.items() for v in kv))
    spelled = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    return F.when(x.rlike("[Α-ω]"), spelled).otherwise(x)


def typographicforms(x: Column) -> Column:
    """N2"""
    return F.translate(x, *TYPOGRAPHIC)


def removequalifiers(x: Column, end_only: bool = False) -> Column:
    """N3"""
    return F.regexp_replace(x, r"\s*?\(.*?\)\s*?" + ("$" if end_only else ""), "")


def trimwhitespaces(x: Column) -> Column:
    """None at the ends; runs of two or more become one space."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\s{2,}", " ")


def removepunctuation(x: Column, replace_with_whitespace: bool = False) -> Column:
    """N5"""
    return F.regexp_replace(x, PUNCTUATION, " " if replace_with_whitespace else "")


def naturalwordorder(x: Column) -> Column:
    """Comma-separated parts in reverse; the first part that is a lone space goes."""
    parts = F.split(x, r"\s?,\s?")
    at = F.array_position(parts, F.lit(" ")).cast("int")
    rest = F.when(at > 0, F.concat(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(parts, at + 1, F.size(parts)))).otherwise(parts)
    return F.array_join(F.reverse(rest), " ")


def to_ascii(x: str | None) -> str | None:
    if x is None or x.isascii():
        return x
    out = []
    for c in unicodedata.normalize("NFKD", "".join(ASCII_OF.get(c, c) for c in x)):
        if c.isascii():
            out.append(c)
        elif not unicodedata.combining(c):
            low = GREEK_ASCII.get(c.lower(), "")
            out.append(low if c.islower() or not low else low.capitalize())
    return "".join(out)


@F.pandas_udf(T.StringType())
def replaceaccents(x: pd.Series) -> pd.Series:
    """N10"""
    return x.map(to_ascii)


def _isolated(f: Callable, word: str | None):
    """A value that a function can't take is null, and the term stays as it was; the other terms aren't touched."""
    try:
        return None if word is None else f(word)
    except Exception:
        return None


@F.pandas_udf(T.StringType())
def stem(x: pd.Series) -> pd.Series:
    """Of the whole value as one word."""
    return x.map(lambda w: _isolated(stem_english, w))


@F.pandas_udf(T.StringType())
def lemmatize(x: pd.Series) -> pd.Series:
    """Of the whole value as one noun."""
    return x.map(lambda w: _isolated(lemma, w))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(x: pd.Series) -> pd.Series:
    """N6"""
    return x.map(lambda w: _isolated(treebank, w))


OPERATIONS: dict[str, Callable] = {
    "greekchars": greekchars,
    "lemmatize": lemmatize,
    "naturalwordorder": naturalwordorder,
    "removepunctuation": removepunctuation,
    "removequalifiers": removequalifiers,
    "replaceaccents": replaceaccents,
    "stem": stem,
    "tokenize": tokenize,
    "trimwhitespaces": trimwhitespaces,
    "typographicforms": typographicforms,
}


def normalize_terms(df: DataFrame, operations: list[str], term_col: str = "term", end_only: bool = False, replace_with_whitespace: bool = False) -> DataFrame:
    """df with `transformed` and `tokens` (null unless `tokenize` is among the operations): one row per row of df, so equal terms keep their URIs.

    An operation that is no string or not known raises ValueError; one that yields null leaves the value as it was.
    """
    if not all(isinstance(o, str) for o in operations):
        raise ValueError("operations must be strings")
    chosen = sorted((o.lower() for o in operations), reverse=True)
    if unknown := set(chosen) - set(OPERATIONS):
        raise ValueError(f"unknown operations: {', '.join(sorted(unknown))}")
    options = {"removequalifiers": {"end_only": end_only}, "removepunctuation": {"replace_with_whitespace": replace_with_whitespace}}
    value, listed = F.col(term_col), F.lit(None).cast("array<string>")
    for o in chosen:
        if o == "tokenize":
            listed = tokenize(value)
            break
        value = F.coalesce(OPERATIONS[o](value, **options.get(o, {})), value)
    return df.select("*", value.alias("transformed"), listed.alias("tokens"))


